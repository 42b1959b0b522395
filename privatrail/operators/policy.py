"""Policies and terms: sentences, clauses, what is collected, why, who receives it, rights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from privatrail.dims import policy as D
from privatrail.functions.text import FLAGS, fold_case_sql, guards_sql, match_spans_sql, rows_with
from privatrail.functions.validators import bind, quoted
from privatrail.operators.pii import redact

CUT = "\u0001"


def any_of(patterns: list[str]) -> str:
    return FLAGS + "|".join(f"(?:{p})" for p in patterns)


def _trimmed(line: Column) -> Column:
    # few lines have white space at an end; the others are not searched
    ends = F.concat(F.substr(line, F.lit(1), F.lit(1)), F.substr(line, F.lit(-1), F.lit(1)))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(line, r"(?U)^\s+|\s+$", "")).otherwise(line)


def _is_heading(p: Column) -> Column:
    words = F.size(F.split(p, r"(?U)\s+"))
    return (F.length(p) < 90) & ~p.rlike("[.!?;]") & (F.endswith(p, F.lit(":")) | (words <= 5))


def sentences(docs: DataFrame, key: str = "doc_id", could: list[D.Guard] | None = None, every_text: bool = False) -> DataFrame:
    """(key, pos, sentence, heading): the sentences of whole texts, line by line, each with its running heading.

    Map-only: a text's lines are divided into sections at its headings inside the row, and the sections exploded.
    ``pos`` is the line times 2^32 plus the place in it, so it orders any text. With ``could`` only
    lines that hold all that one of these guards asks for are cut, the others have no sentences here; ``every_text`` then
    leaves each text that has a sentence one at least.
    """
    lines = F.filter(
        F.transform(F.split("text", "\n+"), lambda x, i: F.struct(i.alias("line"), _trimmed(x).alias("p"))), lambda s: s["p"] != ""
    )
    heads = F.filter(F.transform("_lines", lambda s, i: F.when((i == 0) | _is_heading(s["p"]), i)), lambda i: i.isNotNull())
    section = F.transform(
        "_heads",
        lambda a, k: F.struct(
            F.when(_is_heading(F.get("_lines", a)["p"]), F.regexp_replace(F.get("_lines", a)["p"], ":+$", "")).otherwise("").alias("heading"),
            F.slice("_lines", a + 1, F.coalesce(F.get("_heads", k + 1), F.size("_lines")) - a).alias("lines"),
        ),
    )
    out = docs.select(key, lines.alias("_lines")).select(key, "_lines", heads.alias("_heads"))
    if every_text:
        # a line that does not begin with a semicolon has a sentence
        out = out.withColumn("_proof", F.get(F.filter("_lines", lambda s: ~F.startswith(s["p"], F.lit(";"))), 0)["line"])
    kept = ["_proof"] if every_text else []
    out = out.select(key, *kept, F.explode(section).alias("s")).select(key, *kept, "s.heading", F.explode("s.lines").alias("l"))
    out = out.select(key, *kept, "heading", "l.line", "l.p")
    if could is not None:
        words = [w for g in could for w in min(g, key=len)]
        wanted = F.expr(bind(fold_case_sql("p"), "low", " OR ".join(f"({guards_sql('low', g)})" for g in could)))
        if every_text:
            proof = F.startswith("p", F.lit(";")) | F.coalesce(F.col("line") == F.col("_proof"), F.lit(False))
            out = rows_with(out.select(key, "heading", "line", "p", proof.alias("_kept")), "p", words, "_kept")
            out = out.where(F.col("_kept") | wanted)
        else:
            out = rows_with(out, "p", words).where(wanted)
    cut = F.regexp_replace("p", r"([.!?])\s+", "$1" + CUT)
    turns = F.contains(F.col("p"), F.lit(";"))
    for word in ("but", "however", "nevertheless"):
        turns = turns | F.contains(F.col("p"), F.lit(word))
    cut = F.when(turns, F.regexp_replace(cut, r";\s*|\s+(?:but|however|nevertheless)\s+", CUT)).otherwise(cut)
    parts = F.filter(F.transform(F.split(cut, CUT), lambda s: F.trim(s)), lambda s: s != "")
    out = out.select(key, "heading", "line", F.posexplode(parts).alias("part", "sentence"))
    return out.select(key, (F.shiftleft(F.col("line").cast("long"), 32) + F.col("part")).alias("pos"), "sentence", "heading")


def _claim_sql(rule: D.ClauseRule) -> str:
    """Is ``sentence``, folded to ``low``, this clause? Most sentences lack its words and end at the guard."""
    claim = f"{guards_sql('low', rule.guard)} AND sentence RLIKE {quoted(FLAGS + rule.requires)} AND sentence RLIKE {quoted(any_of(rule.positive))}"
    return claim + (f" AND NOT sentence RLIKE {quoted(any_of(rule.negative))}" if rule.negative else "")


def _clause_rules(clauses: list[str] | None) -> list[D.ClauseRule]:
    return [r for r in D.CLAUSES if clauses is None or r.name in clauses]


def claim_guards(clauses: list[str] | None = None) -> list[D.Guard]:
    """What a line must hold for a sentence of it to be one of ``clauses`` (of all without it)."""
    return [r.guard for r in _clause_rules(clauses)]


def clause_claims(sents: DataFrame, key: str = "doc_id", clauses: list[str] | None = None) -> DataFrame:
    """(key, pos, clause, confidence, sentence, heading): sentences that really are one of ``clauses`` (of all without it)."""
    found = []
    for rule in _clause_rules(clauses):
        scoped = " OR ".join(f"contains(lower(heading), {quoted(word.lower())})" for word in rule.scope) or "false"
        found.append(f"CASE WHEN {_claim_sql(rule)} THEN named_struct('clause', {quoted(rule.name)}, 'confidence', CASE WHEN {scoped} THEN 0.96D ELSE 0.9D END) END")
    met = F.expr(bind(fold_case_sql("sentence"), "low", f"array_compact(array({', '.join(found)}))"))
    # outer: a plain explode would have the optimizer test the array first, and so match every pattern twice
    out = sents.select(key, "pos", "sentence", "heading", F.explode_outer(met).alias("c"))
    return out.where(F.col("c").isNotNull()).select(key, "pos", "c.clause", "c.confidence", "sentence", "heading")


def best_clauses(claims: DataFrame, key: str = "doc_id") -> DataFrame:
    """One sentence per document and clause: the most confident, of those the first. Only given columns are carried."""
    best = F.min_by(
        F.struct(*[c for c in claims.columns if c not in (key, "clause")]), F.struct((-F.col("confidence")).alias("c"), F.col("pos").alias("p"))
    )
    return claims.groupBy(key, "clause").agg(best.alias("b")).select(key, "clause", "b.*")


def with_citations(clauses: DataFrame) -> DataFrame:
    """Quoted sentence and section, whole and free of identifiers."""
    quoted_ = redact(clauses, text="sentence").withColumn("citation", F.col("redacted")).drop("redacted", "n_spans")
    named = redact(quoted_, text="heading").withColumn("section", F.col("redacted")).drop("redacted", "n_spans")
    return named.drop("sentence", "heading")


def terms_summary(docs: DataFrame, clauses: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: digest, whether it is missing, clause names, what is ordinary."""
    names = clauses.groupBy(key).agg(F.sort_array(F.collect_set("clause")).alias("clauses"))
    none = F.array().cast("array<string>")
    out = docs.select(
        key, F.sha2("text", 256).alias("digest"), (F.trim("text") == "").alias("missing")
    ).join(names, key, "left").withColumn("clauses", F.coalesce("clauses", none))

    def has(*names_: str) -> Column:
        return F.arrays_overlap("clauses", F.array(*map(F.lit, names_)))

    ordinary = F.array_compact(
        F.array(
            F.when(~has("automatic_renewal", "liability_cap"), "payment"),
            F.when(~has("minimum_age", "account_termination_without_notice"), "account_creation"),
            F.lit("basic_service_usage"),
        )
    )
    return out.withColumn("ordinary", F.when(F.col("missing"), none).otherwise(ordinary))


def _unnegated_sql(text: str, pattern: str) -> str:
    """Does some match of the pattern stand outside a negation?"""
    spans = match_spans_sql(text, pattern)
    return f"exists({spans}, m -> NOT substr({text}, 1, m.s) RLIKE {quoted(FLAGS + D.NEGATION)})"


def _stated_guard(name: str, pattern: str) -> str:
    # a guard holds for the package's own pattern, not for a caller's of the same name
    own = pattern in (D.PURPOSES.get(name), D.RECIPIENTS.get(name))
    return guards_sql("low", D.STATED_GUARDS[name]) if own else "true"


def _labels_sql(rules: dict[str, str]) -> str:
    tests = [
        f"CASE WHEN {_stated_guard(n, p)} AND sentence RLIKE {quoted(FLAGS + p)} AND {_unnegated_sql('sentence', p)} THEN {quoted(n)} END"
        for n, p in rules.items()
    ]
    return f"array_compact(array({', '.join(tests)}))"


def stated_labels(sents: DataFrame, rules: dict[str, str], key: str = "doc_id") -> DataFrame:
    """(key, label): labels some sentence states without negating them."""
    labels = F.expr(bind(fold_case_sql("sentence"), "low", _labels_sql(rules)))
    met = sents.select(key, F.explode_outer(labels).alias("label"))
    return met.where(F.col("label").isNotNull()).distinct()


def used_purposes(sents: DataFrame, claims: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, label): purposes a text states; a clause on training adds its own."""
    trained = claims.where("clause = 'training_on_user_content'").select(key, F.lit("ai_training").alias("label"))
    return stated_labels(sents, D.PURPOSES, key).unionByName(trained).distinct()


def _says_sql(text: str, pattern: str) -> str:
    return bind(fold_case_sql(text), "low", f"{guards_sql('low', D.SHARING_GUARD)} AND {text} RLIKE {quoted(FLAGS + pattern)}")


_SHARING = f"({_says_sql('sentence', D.SHARING_SENTENCE)} OR {_says_sql('heading', D.SHARING_HEADING)})"


def sharing_sentences(sents: DataFrame) -> DataFrame:
    return sents.where(_SHARING)


def purposes_and_recipients(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, label, kind): ``used_purposes`` and the recipients that sharing sentences state, in one pass over the sentences."""
    training = next(r for r in D.CLAUSES if r.name == "training_on_user_content")
    purposes = f"concat({_labels_sql(D.PURPOSES)}, CASE WHEN {_claim_sql(training)} THEN array('ai_training') ELSE array() END)"
    recipients = f"CASE WHEN {_SHARING} THEN {_labels_sql(D.RECIPIENTS)} ELSE array() END"
    both = [f"transform({labels}, n -> named_struct('label', n, 'kind', '{kind}'))" for labels, kind in ((purposes, "purpose"), (recipients, "recipient"))]
    met = sents.select(key, F.explode_outer(F.expr(bind(fold_case_sql("sentence"), "low", f"concat({', '.join(both)})"))).alias("m"))
    return met.where(F.col("m").isNotNull()).select(key, "m.label", "m.kind").distinct()


def collected(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, category): data categories the text says are collected.

    Only the part of a sentence that names what is taken counts: all of it under a collection
    heading, else what follows the verb, or the last enumeration behind it.
    """
    def up_to(pattern: str, guard: D.Guard) -> str:
        # most sentences lack the verbs and end at the guard
        return f"CASE WHEN {guards_sql('low', guard)} THEN length(regexp_extract(sentence, {quoted('(?s)' + FLAGS + '^.*?' + pattern)}, 0)) ELSE 0 END"

    handling = f"named_struct('has_verb', false, 'after', {up_to(D.HANDLING_VERB, D.HANDLING_GUARD)})"
    after = bind(up_to(D.COLLECTION_VERB, D.COLLECTION_GUARD), "n", f"CASE WHEN n > 0 THEN named_struct('has_verb', true, 'after', n) ELSE {handling} END")
    headed = F.col("heading").rlike(FLAGS + D.COLLECTION_HEADING)
    rest = F.expr("substr(sentence, after + 1)")
    listed = F.regexp_extract(rest, "(?s)" + FLAGS + "^.*" + D.ENUMERATION, 0)
    cut = sents.select(key, "sentence", headed.alias("headed"), F.expr(bind(fold_case_sql("sentence"), "low", after)).alias("found"))
    cut = cut.select(key, "sentence", "headed", F.col("found.has_verb").alias("has_verb"), F.col("found.after").alias("after"))
    cut = cut.where(F.col("headed") | (F.col("after") > 0)).withColumn("listed", F.length(listed))
    cut = cut.where(F.col("headed") | F.col("has_verb") | (F.col("listed") > 0)).withColumn(
        "at", F.when(F.col("headed"), 0).otherwise(F.col("after") + F.col("listed"))
    )
    cut = cut.withColumn("body", F.expr("substr(sentence, at + 1)"))
    tests = []
    for name, pattern in D.COLLECTS.items():
        bad = f"substr(sentence, 1, at + m.s) RLIKE {quoted(FLAGS + D.NEGATION)}"
        if name in D.NOT_ABOUT_YOU:
            around = "substr(sentence, greatest(at + m.s - 40, 0) + 1, at + m.e + 40 - greatest(at + m.s - 40, 0))"
            bad += f" OR {around} RLIKE {quoted(FLAGS + D.NOT_ABOUT_YOU[name])}"
        tests.append(
            f"CASE WHEN body RLIKE {quoted(FLAGS + pattern)} AND exists({match_spans_sql('body', pattern)}, m -> NOT ({bad})) THEN {quoted(name)} END"
        )
    met = cut.select(key, F.explode_outer(F.expr(f"array_compact(array({', '.join(tests)}))")).alias("category"))
    return met.where(F.col("category").isNotNull()).distinct()


def rights_and_contacts(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: user rights, the last sentence on children, the last contact sentence, both redacted."""
    low = F.lower("sentence")
    flags = [F.bool_or(low.rlike("(?Ud)" + p)).alias(n) for n, p in D.RIGHTS.items()]

    def last(pattern: str) -> Column:
        hit = low.rlike("(?Ud)" + pattern)
        return F.max_by(F.when(hit, F.col("sentence")), F.when(hit, F.col("pos")))

    g = sents.groupBy(key).agg(*flags, last(D.CHILDREN).alias("children"), last(D.CONTACT).alias("contact"))
    rights = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in D.RIGHTS]))
    out = g.select(key, F.sort_array(rights).alias("rights"), "children", "contact")
    for name in ("children", "contact"):
        out = redact(out, text=name).withColumn(name, F.col("redacted")).drop("redacted", "n_spans")
    return out


def retention_guards() -> list[D.Guard]:
    """What a line must hold for a sentence of it to say how long data is kept."""
    return [D.PERIOD_GUARD, D.UNTIL_DELETION_GUARD, *claim_guards([D.KEPT_CLAUSE])]


def retention(sents: DataFrame, clauses: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Retention class (the last statement wins, a clause beats both) and stated period. Without ``clauses`` the clause is
    looked for in the same pass."""
    # most sentences lack the words and end at the guards
    period = f"CASE WHEN {guards_sql('low', D.PERIOD_GUARD)} THEN regexp_extract(low, {quoted('(?Ud)' + D.PERIOD)}, 1) ELSE '' END"
    until = f"{guards_sql('low', D.UNTIL_DELETION_GUARD)} AND low RLIKE {quoted('(?Ud)' + D.UNTIL_DELETION)}"
    claim = bind(fold_case_sql("sentence"), "low", _claim_sql(_clause_rules([D.KEPT_CLAUSE])[0])) if clauses is None else "false"
    read = F.expr(bind("lower(sentence)", "low", f"named_struct('period', {period}, 'until', {until})"))
    sents = sents.select(key, "pos", read.alias("r"), F.expr(claim).alias("kept"))
    sents = sents.select(key, "pos", "kept", F.col("r.period").alias("period"), F.col("r.until").alias("until"))
    period = F.col("period")
    kind = F.when(F.col("until"), "until_deletion").when(period != "", "stated_period")
    g = sents.groupBy(key).agg(
        F.max_by(kind, F.when(kind.isNotNull(), F.col("pos"))).alias("kind"),
        F.max_by(F.when(period != "", period), F.when(period != "", F.col("pos"))).alias("period"),
        F.bool_or("kept").alias("kept"),
    )
    if clauses is not None:
        claimed = clauses.where(F.col("clause") == D.KEPT_CLAUSE).select(key).distinct().withColumn("kept", F.lit(True))
        g = g.drop("kept").join(claimed, key, "left")
    return g.select(
        key, F.when(F.col("kept"), "after_deletion").otherwise(F.coalesce("kind", F.lit("unspecified"))).alias("retention"), "period"
    )


def over_collected(found: DataFrame, purposes: DataFrame, necessity: DataFrame, key: str = "doc_id") -> DataFrame:
    """Collected categories the site's purpose has no evident use for."""
    wanted = necessity.where(F.col("verdict").isin("unnecessary", "red_flag")).select(F.col("purpose").alias("site_purpose"), "category")
    return found.join(purposes.select(key, "site_purpose"), key).join(wanted, ["site_purpose", "category"], "left_semi")


def merge_site_profiles(clauses_by_site: DataFrame) -> DataFrame:
    """(site, clause) to one profile row per site."""
    def has(name: str) -> Column:
        return F.bool_or(F.col("clause") == name)

    return clauses_by_site.groupBy("site").agg(
        F.sort_array(F.collect_set("clause")).alias("clauses"), has("training_on_user_content").alias("training_on_user_content"),
        has("data_sale").alias("data_sale"), has("cross_border_transfer").alias("international_transfer"),
        F.when(has("retention_after_deletion"), "after_deletion").otherwise("unspecified").alias("retention"),
    )


def reading_time(docs: DataFrame) -> DataFrame:
    words = F.when(F.trim("text") == "", 0).otherwise(F.size(F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), r"\s+")))
    return docs.withColumn("words", words).withColumn("minutes", F.ceil(F.col("words") / D.READING_WPM))


def micro_f1(pairs: DataFrame) -> DataFrame:
    """pairs(key, label, expected, observed) booleans to one row of counts and F1."""
    e, o = F.col("expected"), F.col("observed")
    c = pairs.agg(F.count_if(e & o).alias("tp"), F.count_if(~e & o).alias("fp"), F.count_if(e & ~o).alias("fn"))
    return c.withColumn("f1", F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))
