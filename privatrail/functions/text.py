"""Column functions on text: exact match spans, guards, redaction."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privatrail.dims.categories import CATEGORIES
from privatrail.functions.validators import bind, quoted

# Unicode-aware and newline-only line ends, so that e.g. accented letters are word characters.
FLAGS = "(?iuUd)"
# the same with word characters, digits and spaces of ASCII alone; for patterns written by ``ascii_words``
ASCII_FLAGS = "(?iud)"
OPEN, CLOSE, VALUE_END = "\u0001", "\u0002", "\u0003"
SPAN_TYPE = "array<struct<s:int,e:int,v:string,m:string>>"
# the placeholder redaction leaves behind, one per category
TOKEN = "<(?:" + "|".join(c.upper().replace(".", r"\.") for c, _, _ in CATEGORIES) + ")>"


def ascii_words(pattern: str) -> str:
    """The pattern with word boundaries of ASCII: Java's own differ between its versions where Unicode classes are off."""
    word = "[A-Za-z0-9_]"
    return pattern.replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")


def clean_text(text: Column) -> Column:
    """Free the three marker characters and blank existing placeholders, keeping all lengths."""
    marks = [F.contains(text, F.lit(c)) for c in (OPEN, CLOSE, VALUE_END)]
    plain = F.when(
        marks[0] | marks[1] | marks[2], F.translate(text, OPEN + CLOSE + VALUE_END, "\u0000\u0000\u0000")
    ).otherwise(text)
    # between two markers sits a placeholder: turn each of its characters into NUL
    pieces = F.transform(
        F.split(F.regexp_replace(plain, "(" + TOKEN + ")", OPEN + "$1" + OPEN), OPEN, -1),
        lambda x, i: F.when(i % 2 == 1, F.repeat(F.lit("\u0000"), F.length(x))).otherwise(x),
    )
    return F.when(F.contains(text, F.lit("<")), F.array_join(pieces, "")).otherwise(plain)


def fold_case_sql(text: str) -> str:
    """Lower case under the same folding the case-insensitive regexes use; few texts hold a letter that needs more."""
    special = f"contains({text}, 'ſ') OR contains({text}, 'ı') OR contains({text}, 'İ')"
    return f"CASE WHEN {special} THEN lower(translate({text}, 'ſıİ', 'sii')) ELSE lower({text}) END"


def fold_case(text: Column) -> Column:
    """Lower case under the same folding the case-insensitive regexes use."""
    return F.lower(F.translate(text, "ſıİ", "sii"))


def marked_sql(text: str, pattern: str, labelled: bool = False, flags: str = FLAGS) -> str:
    """SQL text for ``text`` with every match wrapped in marker characters: the match, then its value, which is group 1
    when ``labelled`` (the pattern must end where group 1 ends) and else the whole match. ``text`` must be free of the
    markers."""
    wrapped = f"'\\u0001$0\\u0002{'$1' if labelled else '$0'}\\u0003'"
    return f"regexp_replace({text}, {quoted(flags + pattern)}, {wrapped})"


def marked_between_sql(text: str, pattern: str) -> str:
    """The same for a pattern of three groups, the second of which is the match and the value; what the others take stays
    outside, but no other match has it."""
    return f"regexp_replace({text}, {quoted(pattern)}, '$1\\u0001$2\\u0002$2\\u0003$3')"


def spans_sql(marked: str) -> str:
    """SQL text for the matches in a marked text with exact offsets, as array<struct<s, e, v, m>> (value and match).

    Offsets are sums of the lengths between markers, taken in two steps of the square root of the number of matches, so
    a text of very many matches does not cost their square.
    """
    c, e = "\\u0002", "\\u0003"
    close, stop = f"instr(x, '{c}')", f"instr(x, '{e}')"
    parsed = (
        f"transform(slice(p, 2, size(p)), x -> named_struct('m', substr(x, 1, {close} - 1), "
        f"'v', substr(x, {close} + 1, {stop} - {close} - 1), 'n', {close} - 1 + length(x) - {stop}))"
    )
    # q: matches with the length from each match to the next; w: how many a block holds; b: where blocks start
    total = "aggregate(slice({0}, {1}, {2}), 0, (acc, y) -> acc + y{3})"
    blocks = f"transform(sequence(0, (size(q) - 1) div w), j -> {total.format('q', 'j * w + 1', 'w', '.n')})"
    starts = bind(blocks, "t", f"transform(t, (y, j) -> length(p[0]) + {total.format('t', '1', 'j', '')})")
    at = f"(b[i div w] + {total.format('q', '(i div w) * w + 1', 'i % w', '.n')})"
    span = "named_struct('s', at + length(x.m) - length(x.v), 'e', at + length(x.m), 'v', x.v, 'm', x.m)"
    walk = f"transform(q, (x, i) -> {bind(at, 'at', span)})"
    walk = bind(parsed, "q", bind("CAST(ceil(sqrt(size(q))) AS INT)", "w", bind(starts, "b", walk)))
    pieces = f"split({marked}, '\\u0001', -1)"
    # most texts have no match and end here; binding the split once keeps the regex from being evaluated per use
    return bind(pieces, "p", f"CASE WHEN size(p) > 1 THEN {walk} ELSE CAST(array() AS {SPAN_TYPE}) END")


def match_spans_sql(text: str, pattern: str, labelled: bool = False, flags: str = FLAGS) -> str:
    """SQL text for all matches of one pattern."""
    return spans_sql(marked_sql(text, pattern, labelled, flags))


def guard_sql(
    folded: str, has_digit: str, words: tuple[str, ...], digits: bool = False, colon: bool = False
) -> str:
    """Cheap superset test: could a pattern with these guard words match at all?"""
    tests = ["(" + " OR ".join(f"contains({folded}, {quoted(w)})" for w in words) + ")"] if words else []
    if colon:
        tests.append(f"(contains({folded}, ':') OR contains({folded}, '='))")
    return " AND ".join(([has_digit] if digits else []) + tests) or "true"


def words_pattern(words: list[str]) -> str:
    """An RE2 pattern that matches where some lower-case word stands, under the folding of ``fold_case``."""
    least = sorted({w for w in words if not any(v != w and v in w for v in words)})
    # RE2 folds letters as Unicode does, which leaves out the i with and without its dot
    return "(?i)" + "|".join(re.sub("i", "[iıİ]", re.escape(w)) for w in least)


def rows_with(df: DataFrame, column: str, words: list[str], keep: str | None = None) -> DataFrame:
    """The rows whose text holds some of the words, and those with ``keep``. One automaton reads a text once for all words,
    batch by batch, where Spark's functions would search it for each."""
    pattern = words_pattern(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pc.fill_null(pc.match_substring_regex(batch.column(column), pattern), False)
            yield batch.filter(pc.or_(found, batch.column(keep)) if keep else found)

    return df.mapInArrow(run, df.schema)


def guards_sql(folded: str, groups: tuple[tuple[str, ...], ...]) -> str:
    """The same for a pattern whose every match holds a word of each group."""
    return " AND ".join(guard_sql(folded, "true", g) for g in groups)


def merge_spans(spans: Column) -> Column:
    """Gaps and islands over spans sorted by (s, -e, category): touching or overlapping
    spans become one, named after the first. In and out: array<struct<s, e, category>>."""
    kind = "array<struct<s:int,e:int,category:string>>"

    def step(state: Column, x: Column) -> Column:
        last = F.element_at(state, -1)
        joined = F.concat(
            F.slice(state, F.lit(1), F.size(state) - 1),
            F.array(
                F.struct(
                    last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"),
                    last["category"].alias("category"),
                )
            ),
        )
        fresh = F.struct(x["s"].alias("s"), x["e"].alias("e"), x["category"].alias("category"))
        return (
            F.when(F.size(state) == 0, F.array(fresh))
            .when(x["s"] <= last["e"], joined)
            .otherwise(F.concat(state, F.array(fresh)))
        )

    return F.aggregate(spans, F.array().cast(kind), step)


def replace_spans(text: Column, islands: Column) -> Column:
    """Replace disjoint sorted islands by their <CATEGORY> placeholder."""
    def step(state: Column, x: Column) -> Column:
        kept = F.substr(text, state["pos"] + 1, x["s"] - state["pos"])
        return F.struct(
            x["e"].alias("pos"),
            F.concat(
                state["out"], F.array(kept, F.concat(F.lit("<"), F.upper(x["category"]), F.lit(">")))
            ).alias("out"),
        )

    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    built = F.aggregate(
        islands,
        start,
        step,
        lambda s: F.array_join(
            F.concat(s["out"], F.array(F.substr(text, s["pos"] + 1, F.length(text)))), ""
        ),
    )
    return F.when(F.size(islands) > 0, built).otherwise(text)


def keep_last_digits(value: Column, keep: int, cover: str = "█") -> Column:
    """Cover everything before the last ``keep`` digits; cover all if there are fewer."""
    tail = F.regexp_extract(value, r"(?U)((?:\d\D*){%d})$" % keep, 1)
    head = F.length(value) - F.length(tail)
    return F.when(tail != "", F.concat(F.repeat(F.lit(cover), head), tail)).otherwise(
        F.repeat(F.lit(cover), F.length(value))
    )


def keep_year(value: Column, cover: str = "█") -> Column:
    """Cover a date down to its year; separators next to the year stay when nothing else is there."""
    pattern = r"(?U)^(.*?)(?<!\d)(1[89]\d{2}|20\d{2})(?!\d)(.*)$"
    head, year, tail = (F.regexp_extract(value, pattern, i) for i in (1, 2, 3))

    def side(part: Column) -> Column:
        bare = F.regexp_replace(part, r"[ \-/.,]", "") == ""
        return F.when(bare, part).otherwise(F.repeat(F.lit(cover), F.length(part)))

    return F.when(year != "", F.concat(side(head), year, side(tail))).otherwise(
        F.repeat(F.lit(cover), F.length(value))
    )
