"""Personal data in text: detection, validation, spans, hashing, redaction."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privatrail.dims import patterns as P
from privatrail.functions import text as T
from privatrail.functions import validators as V
from privatrail.functions.validators import bind, quoted

class Rule(NamedTuple):
    """A pattern as data: what a text must hold for it to match, and the checksum its values must pass."""

    category: str
    pattern: str
    confidence: float
    guard: str  # SQL over the folded text fw and hd, whether there is a digit
    labelled: bool
    check: str


def _iban_cut(x: str) -> str:
    """Cut a greedy IBAN candidate to the country's legal length; unknown or short ones get no end."""
    solid = f"filter(sequence(1, length({x}.v)), i -> substr({x}.v, i, 1) RLIKE {quoted(r'(?U)\S')})"
    stop = f"get({solid}, {V.iban_length_sql(f'{x}.v')} - 1)"
    return bind(stop, "n", f"named_struct('s', {x}.s, 'e', {x}.s + n, 'v', substr({x}.v, 1, n), 'm', substr({x}.v, 1, n))")


def _national_id(x: str) -> str:
    digits = f"regexp_replace(trim({x}.v), '[ -]', '')"
    return (
        f"CASE WHEN {digits} RLIKE '^[0-9]{{12}}$' THEN {V.national12_sql(x + '.v')} "
        f"WHEN {digits} RLIKE '^[0-9]{{16}}$' THEN {V.national16_sql(x + '.v')} END"
    )


#: SQL that is true, false (the match is dropped) or null (this value carries no checksum).
CHECKS = {
    "luhn": lambda x: V.luhn_sql(f"{x}.v"),
    "iban": lambda x: V.iban_sql(f"{x}.v"),
    "ssn": lambda x: V.ssn_sql(f"trim({x}.v)"),
    "mrz": lambda x: V.mrz_sql(f"{x}.v"),
    "aba": lambda x: V.aba_sql(f"trim({x}.v)"),
    "nhs": lambda x: f"CASE WHEN contains(lower({x}.m), 'nhs') THEN {V.nhs_sql(f'trim({x}.v)')} END",
    "national": _national_id,
    "twelve": lambda x: V.national12_sql(f"{x}.v"),
    "sixteen": lambda x: V.national16_sql(f"{x}.v"),
}
_STANDALONE_CHECK = {"financial.card_number": "luhn", "financial.iban": "iban", "government_id.ssn": "ssn", "government_id.passport": "mrz"}
_LABELLED_CHECK = {"government_id.ssn": "ssn", "financial.routing": "aba", "medical.insurance_id": "nhs", "government_id.national_id": "national"}
_MARKER_WORDS = ("aadha", "आधार", "uidai", "unique", "government", "भारत", "vid", "vtc")


def _rules() -> list[Rule]:
    """All patterns in their order, which decides between equal spans: the later one wins."""
    out = [
        Rule(r.category, r.pattern, r.confidence, T.guard_sql("fw", "hd", r.guard, r.digits, r.colon), False, _STANDALONE_CHECK.get(r.category, ""))
        for r in P.STANDALONE
    ]
    out += [
        Rule(r.category, r.pattern, r.confidence, T.guard_sql("fw", "hd", r.guard, r.digits, r.colon), True, _LABELLED_CHECK.get(r.category, ""))
        for r in P.LABELLED
    ]
    for pattern, check in ((P.CARD_BARE_12, "twelve"), (P.CARD_BARE_16, "sixteen")):
        out.append(Rule("government_id.national_id", pattern, P.CARD_CONFIDENCE, "card", True, check))
    out.append(Rule("phone", P.PHONE_PATTERN, P.PHONE_CONFIDENCE, "hd", False, ""))
    return out


RULES = _rules()


def _pick(values: dict[int, str], otherwise: str) -> str:
    """SQL for a property of rule r; rules that share a value share a branch."""
    same: dict[str, list[int]] = {}
    for r, v in values.items():
        same.setdefault(v, []).append(r)
    branches = " ".join(f"WHEN r IN ({', '.join(map(str, rs))}) THEN {v}" for v, rs in same.items())
    return f"CASE {branches} ELSE {otherwise} END" if branches else otherwise


def _marked_rule_sql(text: str, rule: Rule, ascii_words: bool, taking_neighbours: bool) -> str:
    if taking_neighbours:
        return T.marked_between_sql(text, P.TAKING_NEIGHBOURS[rule.category])
    if ascii_words:
        return T.marked_sql(text, T.ascii_words(rule.pattern), rule.labelled, T.ASCII_FLAGS)
    return T.marked_sql(text, rule.pattern, rule.labelled)


def _scan_sql(
    text: str, categories: list[str] | None = None, ascii_words: tuple[str, ...] = (), taking_neighbours: tuple[str, ...] = ()
) -> str:
    """SQL text for all matches inside one text, as one array of (s, e, v, category, confidence, validated, ord).

    The guards are looked up once a text and leave the rules that could match. Their patterns stand in one CASE; walking
    the matches, cutting, checking and naming them is written once and driven by the rule's number r. Only the rules of
    ``categories`` are built (all without it; those in ``ascii_words`` with word characters of ASCII), and for phones those that keep a phone from starting inside them. A
    result never depends on how texts are cut, as they are not. Categories in ``taking_neighbours`` have their free-standing
    pattern alone, with its neighbours taken; as phones there, nothing keeps them from starting inside other numbers.
    """
    blocked = "phone" not in taking_neighbours
    wanted = None if categories is None else {*categories, *(P.PHONE_BLOCKERS if blocked and "phone" in categories else ())}
    rules = {i: r for i, r in enumerate(RULES) if (wanted is None or r.category in wanted) and not (r.labelled and r.category in taking_neighbours)}
    none = "CAST(array() AS array<struct<s:int,e:int,v:string,category:string,confidence:double,validated:boolean,ord:int>>)"
    if not rules:
        return none
    on_card = f"(hd AND {card_named_sql(text, 'fw')})" if any(r.guard == "card" for r in rules.values()) else "false"
    tests = [f"CASE WHEN {on_card if r.guard == 'card' else r.guard} THEN {i} END" for i, r in rules.items()]
    could = f"filter(array({', '.join(tests)}), r -> r IS NOT NULL)"
    marked = "CASE r " + " ".join(f"WHEN {i} THEN {_marked_rule_sql(text, r, r.category in ascii_words, r.category in taking_neighbours)}" for i, r in rules.items()) + " END"
    spans = T.spans_sql(marked)
    iban = [i for i, r in rules.items() if r.check == "iban"]
    if iban:
        spans = f"transform({spans}, x -> CASE WHEN r = {iban[0]} THEN {_iban_cut('x')} ELSE x END)"
    # what was cut away, and values that are a placeholder, are no matches
    spans = f"filter({spans}, x -> x.e IS NOT NULL AND NOT ({_pick({i: 'true' for i, r in rules.items() if r.labelled}, 'false')} AND startswith(trim(x.v), '\\u0000')))"
    verdict = _pick({i: CHECKS[r.check]("x") for i, r in rules.items() if r.check}, "CAST(NULL AS BOOLEAN)")
    checked = f"filter(transform({spans}, x -> named_struct('x', x, 'ok', {verdict})), y -> coalesce(y.ok, true))"
    named = _pick({i: quoted(r.category) for i, r in rules.items()}, "NULL")
    sure = _pick({i: f"CAST({r.confidence} AS DOUBLE)" for i, r in rules.items()}, "NULL")
    tagged = (
        f"transform({checked}, y -> named_struct('s', y.x.s, 'e', y.x.e, 'v', y.x.v, 'category', {named}, "
        f"'confidence', {sure}, 'validated', coalesce(y.ok, false), 'ord', r))"
    )
    body = f"flatten(transform({could}, r -> {tagged}))"
    if blocked and any(r.category == "phone" for r in rules.values()):
        # a phone number does not start inside a card, IBAN or security number
        blocker = "b.category IN (" + ", ".join(f"'{c}'" for c in P.PHONE_BLOCKERS) + ")"
        last = len(RULES) - 1  # the labelled pattern for phones is another rule
        free = f"filter(o, p -> p.ord <> {last} OR NOT exists(k, b -> b.s <= p.s AND p.s < b.e))"
        body = bind(body, "o", bind(f"filter(o, b -> {blocker})", "k", free))
    return bind(T.fold_case_sql(text), "fw", bind(f"{text} RLIKE {quoted(r'(?U)\d')}", "hd", body))


def card_named_sql(text: str, folded: str) -> str:
    """Does the text name an identity card, so that bare numbers in it count?"""
    return f"({T.guard_sql(folded, 'true', _MARKER_WORDS, False)} AND {text} RLIKE {quoted(T.FLAGS + P.CARD_MARKERS)})"


def find_matches(
    docs: DataFrame, key: list[str] | None = None, text: str = "text", categories: list[str] | None = None,
    distinct_texts: bool = False, ascii_words: tuple[str, ...] = (), taking_neighbours: tuple[str, ...] = (),
) -> DataFrame:
    """Every match of every pattern: (key, category, start, end, value, confidence, validated).

    The scan is map-only; only matches are shuffled, to merge those that several patterns report. ``categories`` builds
    the patterns of these alone. ``distinct_texts`` scans each distinct text once and joins the result back. Categories
    in ``ascii_words`` are read as engines without Unicode classes read them: an accented letter ends a word. Those in
    ``taking_neighbours`` (of ``P.TAKING_NEIGHBOURS``) are read as engines without look-arounds read them: of two numbers one
    character apart the second lacks that character.
    """
    key = key or ["doc_id"]
    clean = docs.where(F.col(text).isNotNull()).select(*key, T.clean_text(F.col(text)).alias("text"))
    scan = F.expr(_scan_sql("text", categories, ascii_words, taking_neighbours))
    if distinct_texts:
        keyed = clean.withColumn("digest", F.sha2("text", 256))
        once = keyed.groupBy("digest").agg(F.first("text").alias("text"))
        hits = keyed.drop("text").join(once.select("digest", scan.alias("hits")), "digest")
    else:
        hits = clean.select(*key, scan.alias("hits"))
    if categories is not None:
        hits = hits.withColumn("hits", F.filter("hits", lambda h: h["category"].isin(categories)))
    # outer: a plain explode lets the optimizer push a test of the scan's result, and so a second scan, below everything
    everything = hits.select(*key, F.explode_outer("hits").alias("hit")).where(F.col("hit").isNotNull())
    best = F.max_by(
        F.struct(F.col("hit.confidence").alias("confidence"), F.col("hit.validated").alias("validated"),
                 F.col("hit.v").alias("value")),
        F.col("hit.ord"),
    )
    return (
        everything.groupBy(
            *key,
            F.col("hit.category").alias("category"),
            F.col("hit.s").alias("start"),
            F.col("hit.e").alias("end"),
        )
        .agg(best.alias("b"))
        .select(*key, "category", "start", "end", "b.value", "b.confidence", "b.validated")
    )


def findings(matches: DataFrame, salt: str, key: list[str] | None = None) -> DataFrame:
    """Matches without their values: span, confidence, and a keyed category-separated hash."""
    key = key or ["doc_id"]
    digest = F.sha2(
        F.concat(F.lit(salt), F.col("category"), F.lit("\u0000"), F.col("value")), 256
    )
    return matches.select(
        *key, "category", "start", "end", "confidence", "validated", digest.alias("stable_hash")
    )


def detect(docs: DataFrame, salt: str, key: list[str] | None = None) -> DataFrame:
    return findings(find_matches(docs, key), salt, key)


def _islands(spans: Column) -> Column:
    """Merge unsorted spans (s, e, category) of one text."""
    ordered = F.sort_array(
        F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("n"), x["category"].alias("category")))
    )
    return T.merge_spans(
        F.transform(ordered, lambda x: F.struct(x["s"].alias("s"), (-x["n"]).alias("e"), x["category"].alias("category")))
    )


def _row_hits(docs: DataFrame, text: str, categories: list[str] | None) -> DataFrame:
    """Adds ``_hits``: all spans of the row's text, found without leaving the row."""
    columns = [c for c in docs.columns if c not in ("_hits", "_t")]
    keep = "true" if categories is None else "z.category IN (" + ", ".join(quoted(c) for c in categories) + ")"
    slim = "named_struct('s', z.s, 'e', z.e, 'category', z.category, 'validated', z.validated)"
    hits = f"transform(filter({_scan_sql('_t', categories)}, z -> {keep}), z -> {slim})"
    return docs.select(*columns, T.clean_text(F.coalesce(text, F.lit(""))).alias("_t")).select(*columns, F.expr(hits).alias("_hits"))


def redact(docs: DataFrame, categories: list[str] | None = None, key: list[str] | None = None, text: str = "text") -> DataFrame:
    """Replace matched spans by placeholders: adds ``redacted`` and ``n_spans``. Map-only."""
    columns = docs.columns
    found = _row_hits(docs, text, categories).select(*columns, _islands(F.col("_hits")).alias("_islands"))
    return found.select(
        *columns, T.replace_spans(F.col(text), F.col("_islands")).alias("redacted"), F.size("_islands").alias("n_spans")
    )


def verify_redaction(redacted: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Adds ``verified``: a rescan finds none of the selected categories and the source was
    whole. Unverified rows must not be released. Map-only."""
    columns = redacted.columns
    partial = F.col("partial") if "partial" in columns else F.lit(False)
    rescanned = _row_hits(redacted, "redacted", categories)
    return rescanned.select(*columns, ((F.size("_hits") == 0) & ~partial).alias("verified"))


def document_type(text: Column, suffix: Column | None = None) -> Column:
    """Keyword vote over six types; ties go to the larger name; photo or generic otherwise."""
    lower = F.lower(text)
    votes = []
    for name, words in P.DOCUMENT_TYPES.items():
        score = F.lit(0)
        for word in words:
            plain = not any(ch in word for ch in r"\.^$*+?{}[]|()")
            # the vote lowers the pattern together with the text
            hit = F.contains(lower, F.lit(word)) if plain else lower.rlike("(?Ud)" + _lowered(word))
            score = score + hit.cast("int")
        votes.append(F.struct(score.alias("score"), F.lit(name).alias("name")))
    best = F.greatest(*votes)
    photo = F.lower(suffix).isin(P.PHOTO_SUFFIXES) if suffix is not None else F.lit(False)
    return F.when(best["score"] > 0, best["name"]).otherwise(F.when(photo, "photo").otherwise("generic"))


def _lowered(pattern: str) -> str:
    # lowering turns \S into \s and so on, exactly as the vote does to its patterns
    return pattern.lower()


def id_scheme(text: Column) -> Column:
    named = text.rlike(T.FLAGS + P.CARD_NAMED + "|" + P.CARD_LAYOUT)
    return F.when(named, "aadhaar").otherwise("")


def mask_values(matches: DataFrame, document_kind: Column, scheme: Column) -> DataFrame:
    """Partial masking of matched values under the document's plan: adds ``masked``.

    On a recognised card the name, gender and age stay readable, the number keeps its last
    four digits and a birth date its year; everything else is covered.
    """
    on_card = (document_kind == "identity_document") & (scheme == "aadhaar")
    digits = F.length(F.regexp_replace("value", r"(?U)\D", ""))
    covered = F.repeat(F.lit("█"), F.length("value"))
    card = (
        F.when(F.col("category").isin("full_name", "gender", "age"), F.col("value"))
        .when(
            F.col("category") == "government_id.national_id",
            F.when(digits == 12, T.keep_last_digits(F.col("value"), 4)).otherwise(covered),
        )
        .when(F.col("category") == "dob", T.keep_year(F.col("value")))
        .otherwise(covered)
    )
    return matches.withColumn("masked", F.when(on_card, card).otherwise(covered))


def address_blocks(docs: DataFrame, spans: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Address blocks by shape: from a line with an uncovered six-digit code back to below
    the nearest line that stays readable, or to the text's beginning. A null text has none.

    ``spans`` (key, start, end, covered) marks covered and kept spans on the text. All else happens
    inside the document's row: its lines are folded once, carrying where the block began.
    """
    none = F.array().cast("array<struct<start:int,end:int,covered:boolean>>")
    if spans is not None:
        per_doc = spans.groupBy(key).agg(
            F.collect_list(F.struct(F.col("start").cast("int").alias("start"),
                                    F.col("end").cast("int").alias("end"), "covered")).alias("spans")
        )
        docs = docs.join(per_doc, key, "left").withColumn("spans", F.coalesce("spans", none))
    else:
        docs = docs.withColumn("spans", none)
    return docs.select(key, F.inline(F.expr(_address_blocks_sql())))


def _address_blocks_sql() -> str:
    """SQL text for the blocks of ``text``. Lines are folded in chunks of the square root of their number, so that many
    blocks in one text do not cost their square when they are gathered."""
    # the last six-digit code of the line and where it ends
    pin = quoted(r"(?Ud)^(.*)(?<!\d)\d{6}(?!\d)")
    above = quoted(T.FLAGS + P.ABOVE_ADDRESS)
    lines = (
        f"transform(split(text, '\\n', -1), x -> named_struct('n', length(x), 'stop', x RLIKE {above}, 'pin', length(regexp_extract(x, {pin}, 0))))"
    )
    stop = "x.stop OR exists(spans, s -> NOT s.covered AND s.start < a.at + x.n AND a.at < s.end)"
    covered = "exists(spans, s -> s.covered AND s.start <= a.at + x.pin - 6 AND a.at + x.pin <= s.end)"
    block = "named_struct('first_line', a.first, 'last_line', a.no, 'start', a.start, 'end', a.at + x.pin)"
    step = (
        f"named_struct('at', a.at + x.n + 1, 'no', a.no + 1, 'first', CASE WHEN {stop} THEN a.no + 1 ELSE a.first END, "
        f"'start', CASE WHEN {stop} THEN a.at + x.n + 1 ELSE a.start END, "
        f"'out', CASE WHEN x.pin > 0 AND a.first < a.no AND NOT {covered} THEN concat(a.out, array({block})) ELSE a.out END)"
    )
    def state(x: str, out: str) -> str:
        return f"named_struct('at', {x}.at, 'no', {x}.no, 'first', {x}.first, 'start', {x}.start, 'out', {out})"

    empty = "CAST(array() AS array<struct<first_line:int,last_line:int,start:int,end:int>>)"
    start = f"named_struct('at', 0, 'no', 0, 'first', 0, 'start', 0, 'out', {empty})"
    chunk = f"aggregate(c, {state('b', empty)}, (a, x) -> {step})"
    gathered = bind(chunk, "d", state("d", "concat(b.out, d.out)"))
    chunks = "transform(sequence(1, size(all_lines), w), i -> slice(all_lines, i, w))"
    folded = f"aggregate({chunks}, {start}, (b, c) -> {gathered}, z -> z.out)"
    blocks = bind(lines, "all_lines", bind("CAST(ceil(sqrt(size(all_lines))) AS int)", "w", folded))
    return f"CASE WHEN text IS NOT NULL THEN {blocks} END"


def evidence(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Where each category was found: page list (multi-page documents only) and metadata.

    ``found`` has (key, category, page, from_metadata). Two-step distinct so that a hot
    document's rows are reduced before they meet.
    """
    pages = found.where("page IS NOT NULL AND NOT from_metadata").select(key, "category", "page").distinct()
    doc_pages = (
        pages.select(key, "page").distinct().groupBy(key).agg(F.count("*").alias("doc_pages"))
    )
    per_category = pages.groupBy(key, "category").agg(F.sort_array(F.collect_set("page")).alias("pages"))
    meta = found.where("from_metadata").select(key, "category").distinct().withColumn("meta", F.lit(True))
    joined = per_category.join(doc_pages, key, "left").join(meta, [key, "category"], "full_outer")
    n = F.size("pages")
    shown = F.array_join(F.transform(F.slice("pages", 1, 3), lambda p: p.cast("string")), ", ")
    page_text = F.concat(
        F.when(n > 1, "Pages ").otherwise("Page "), shown,
        F.when(n > 3, F.concat(F.lit(" and "), (n - 3).cast("string"), F.lit(" more"))).otherwise(""),
    )
    parts = F.array_compact(
        F.array(
            F.when((n > 0) & (F.col("doc_pages") > 1), page_text),
            F.when(F.col("meta"), F.lit("in the metadata")),
        )
    )
    return joined.select(key, "category", F.array_join(parts, " · ").alias("detail")).where("detail <> ''")


def corpus_profile(found: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings by (source, category) with subtotals: matches and documents affected."""
    joined = found.select(key, "category").join(docs.select(key, "source"), key)
    # first per document, so that the distinct count below needs no expansion of all findings
    per_doc = joined.groupBy("source", "category", key).agg(F.count("*").alias("n"))
    return per_doc.rollup("source", "category").agg(
        F.grouping_id().alias("level"),
        F.sum("n").alias("findings"),
        F.countDistinct(key).alias("docs_affected"),
    )


def _normalise(batches):
    """NFKC (Spark has no such function), batch by batch."""
    import unicodedata

    for pdf in batches:
        pdf["text"] = pdf["text"].map(lambda t: unicodedata.normalize("NFKC", t))
        yield pdf


def outbound_text(text: Column) -> Column:
    """Invisible characters out, dashes unified, URL encoding undone up to three times."""
    # fixed values: dashes that read as a hyphen
    value = F.translate(F.regexp_replace(text, r"\p{Cf}", ""), "‐‑‒–—−", "------")
    def decoded(v: Column) -> Column:
        # a percent sign that starts no escape, and a plus sign, stand for themselves
        plain = F.regexp_replace(F.regexp_replace(v, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
        return F.when(F.contains(v, F.lit("%")), F.coalesce(F.try_url_decode(plain), v)).otherwise(v)

    for _ in range(3):
        value = F.transform(F.array(value), decoded)[0]
    return value


def sanitize_outbound(docs: DataFrame, key: list[str], passes: int = 3) -> DataFrame:
    """Adds ``clean`` and ``refused``: texts are redacted again and again, up to ``passes`` times, and a row in which a
    checksum-validated identifier still stands is refused whole. Only texts outside ASCII pass through Python."""
    slim = docs.select(*key, "text")
    foreign = F.coalesce(F.col("text").rlike(r"[^\x00-\x7F]"), F.lit(False))
    step = slim.where(~foreign).unionByName(slim.where(foreign).mapInPandas(_normalise, slim.schema))
    step = step.select(*key, outbound_text(F.col("text")).alias("clean"))
    for _ in range(passes):
        step = redact(step, key=key, text="clean").select(*key, F.col("redacted").alias("clean"))
    left = _row_hits(step, "clean", None)
    return left.select(*key, "clean", F.exists("_hits", lambda z: z["validated"]).alias("refused"))
