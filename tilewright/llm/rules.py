"""Quality rules: a threshold table compiled into one projection of ratios, without user functions.

A measure is a column expression over a text, its words and its lines. A rule bounds the ratio of
two measures. ``compile_rules`` turns a table of rules into one boolean column; since bounds are
compared by cross-multiplying whole numbers, no rounding decides a verdict. Everything is a
projection, so there is no shuffle, and each text is judged inside the task that reads it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.binding import let

#: Fixed values of the contract: what separates words, what a symbol is, and the two base rules.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
LEAST_WORDS, MOST_REPEATED = 50, (50, 100)
#: Frequent words of the languages that the rules know.
STOP_WORDS = (
    "the of and to in is it that for was on are be this with as from by at an or not "
    "der die das und den von zu mit ist nicht ein eine auf im dem des sich "
    "le la les de des et un une du en que qui dans pour sur est par au "
    "el los las del y que es por con para una su se lo al"
).split()
#: Bits of a window's place in its sort key; a text with more words takes the other way.
PLACE_BITS = 24


MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_capitals", "n_shouts", "n_stops", "n_bullets", "n_cut_lines",
)


@dataclass(frozen=True)
class Rule:
    """``low <= part / whole <= high`` as fractions of whole numbers; a bound of None isn't asked. A text whose ``whole`` is 0 passes."""

    name: str
    part: str
    whole: str
    low: tuple[int, int] | None = None
    high: tuple[int, int] | None = None

    def passed(self) -> Column:
        part, whole = F.col(self.part), F.col(self.whole)
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (part * self.low[1] >= whole * self.low[0])
        if self.high is not None:
            ok = ok & (part * self.high[1] <= whole * self.high[0])
        return ok | (whole == 0)


#: The threshold table: measures by name, and their bounds.
RULES = (
    Rule("word length", "word_chars", "n_words", (2, 1), (12, 1)),
    Rule("symbols", "n_symbols", "n_words", None, (1, 10)),
    Rule("stop words", "n_stop_words", "n_words", (2, 100), None),
    Rule("capitals", "n_capitals", "word_chars", None, (4, 10)),
    Rule("exclamations", "n_shouts", "n_words", None, (1, 4)),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, (1, 2)),
    Rule("bullets", "n_bullets", "n_lines", None, (9, 10)),
    Rule("cut lines", "n_cut_lines", "n_lines", None, (1, 2)),
    Rule("sentence ends", "n_stops", "n_words", (1, 200), None),
)


def compile_rules(rules: Sequence[Rule] = RULES) -> Column:
    """Whether a row of measures passes all rules of a table."""
    out = F.lit(True)
    for r in rules:
        out = out & r.passed()
    return out


def failed_rules(rules: Sequence[Rule] = RULES) -> Column:
    """Names of the rules that a row of measures breaks, in the order of the table."""
    return F.filter(F.array(*[F.when(~r.passed(), F.lit(r.name)) for r in rules]), lambda r: r.isNotNull())


def words_of(text: Column) -> Column:
    """Words of a text, as an array: runs of anything but blanks, tabs and line ends."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _free(columns: Sequence[str]) -> str:
    """A prefix that no column begins with."""
    prefix = "__"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def _covered(places: Column) -> Column:
    """How many words the windows that begin at these places cover together."""
    further = lambda k: F.transform(places, lambda p: p + k)
    return F.size(F.array_distinct(F.concat(*[further(k) for k in range(WINDOW)]))).cast("long")


def _repeats_by_text(words: Column) -> Column:
    """Places of the windows found twice or more; windows are sorted as text."""
    window = lambda i: F.struct(F.array(*[F.get(words, i + k) for k in range(WINDOW)]).alias("w"), i.cast("long").alias("i"))
    beside = lambda s, x, i: F.get(s, i)["w"] == x["w"]
    sorted_ = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), window))
    return let(sorted_, lambda s: F.transform(F.filter(s, lambda x, i: beside(s, x, i - 1) | beside(s, x, i + 1)), lambda x: x["i"]))


def with_repeated_words(df: DataFrame, words: str, name: str, place_bits: int = PLACE_BITS) -> DataFrame:
    """Words of a text that lie in windows of WINDOW words found twice or more in it, the first place included.

    Each window is one long: the upper bits of its hash, and its place. Sorted, equal hashes are
    neighbours, so only windows with a neighbour are looked at, and their words are compared. If
    two neighbours of one hash differ, or the text is too long for the places, the windows are
    sorted as text. The steps are columns of their own, as arrays of longs are sorted fastest so.
    """
    free, low = _free(df.columns), (1 << place_bits) - 1
    h, k, s, p = (F.col(f"{free}{x}") for x in "hksp")
    w, none = F.col(words), F.array().cast("array<bigint>")
    last = F.size(w) - WINDOW
    fits = (last > 0) & (last <= low)
    key = lambda x, i: F.xxhash64(x, *[F.get(h, i + d) for d in range(1, WINDOW)]).bitwiseAND(F.lit(~low & (1 << 63) - 1))
    # Keys aren't negative, so two of one hash differ in the places alone; beyond the ends there is null, which no filter takes.
    beside = lambda a, x, i: F.get(a, i).bitwiseXOR(x) <= low
    at = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    differ = lambda a, b: reduce(or_, [F.get(w, a + d) != F.get(w, b + d) for d in range(WINDOW)])
    out = df.withColumn(f"{free}h", F.when(fits, F.transform(w, lambda x: F.xxhash64(x))).otherwise(none))
    out = out.withColumn(f"{free}k", F.when(fits, F.transform(F.slice(h, F.lit(1), last + 1), lambda x, i: key(x, i).bitwiseOR(i.cast("long")))).otherwise(none))
    out = out.withColumn(f"{free}s", F.sort_array(k)).withColumn(f"{free}p", F.filter(s, lambda x, i: beside(s, x, i + 1) | beside(s, x, i - 1)))
    clashes = F.filter(p, lambda x, i: (beside(p, x, i + 1)) & differ(at(x), at(F.get(p, i + 1))))
    by_text = _covered(_repeats_by_text(w))
    found = F.when(F.size(clashes) == 0, _covered(F.transform(p, lambda x: x.bitwiseAND(F.lit(low))))).otherwise(by_text)
    count = F.when(last > low, by_text).when(F.size(p) > 0, found).otherwise(F.lit(0).cast("long"))
    return out.withColumn(name, count).drop(*[f"{free}{x}" for x in "hksp"])


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with all measures of their text beside them; columns of the same names are replaced.

    Nulls count as empty texts: all measures are 0. Lines are what \\n separates; those without a word don't count.
    """
    free = _free(docs.columns)
    body, words, lines, odd = (F.col(f"{free}{x}") for x in ("text", "words", "lines", "odd"))
    base = docs.withColumn(f"{free}text", F.coalesce(F.col(text), F.lit("")))
    lined = F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    # Letters and blanks go in one pass, so that counts of rare characters look at few.
    base = base.withColumns({f"{free}words": words_of(body), f"{free}lines": lined, f"{free}odd": F.regexp_replace(body, r"[a-z \x{df}-\x{ff}]+", "")})
    n = lambda c: c.cast("long")
    among = lambda a, p: n(F.size(F.filter(a, p)))
    chars = lambda c: n(F.length(odd) - F.length(without(odd, c)))
    measured = base.withColumns(
        {
            "n_words": n(F.size(words)),
            "word_chars": n(F.length(F.array_join(words, ""))),
            "n_symbols": chars(SYMBOLS),
            "n_lines": n(F.size(lines)),
            "n_dup_lines": n(F.size(lines) - F.size(F.array_distinct(lines))),
            "n_stop_words": among(words, lambda w: w.isin(STOP_WORDS)),
            "n_capitals": chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            "n_shouts": chars("!"),
            "n_stops": chars(".!?"),
            "n_bullets": among(lines, lambda x: F.ltrim(x).rlike("^[-*\u2022]")),
            "n_cut_lines": among(lines, lambda x: F.rtrim(x).rlike("(\\.\\.\\.|\u2026)$")),
        }
    )
    measured = with_repeated_words(measured, f"{free}words", "n_repeat_words")
    # Filters on the measures stay above the generator; pushed further, they would work the measures out anew at each mention.
    return measured.select(*[c for c in docs.columns if c.lower() not in MEASURES], F.inline_outer(F.array(F.struct(*MEASURES))))


def judged(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows with their measures, ``base_failed``, ``broken`` (names of the rules broken) and ``kept``.

    ``base_failed``: fewer than LEAST_WORDS words, or more than half of them in repeated windows.
    Empty texts and nulls fail there. Rows are judged one by one, so repeated rows get equal
    verdicts and an empty table gives none. Texts of any length are judged whole.
    """
    part, whole = MOST_REPEATED
    base = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * whole > F.col("n_words") * part)
    out = with_measures(docs, text).withColumns({"base_failed": base, "broken": failed_rules(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that pass the base rules and the table, with their own columns only."""
    row = f"{_free(docs.columns)}row"
    return judged(docs.withColumn(row, F.struct(*docs.columns)), text, rules).where("kept").select(f"{row}.*")


def op13_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_rule(rule: Rule) -> str:
    parts = [f"{rule.part} * {rule.low[1]} >= {rule.whole} * {rule.low[0]}"] if rule.low else []
    parts += [f"{rule.part} * {rule.high[1]} <= {rule.whole} * {rule.high[0]}"] if rule.high else []
    return f"({rule.whole} = 0 or {' and '.join(parts)})"


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP13_SQL = rf"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents
), x as (
  select r, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) as g from d where len(w) > 2
), c as (
  select r, count(distinct p) as n from (
    select r, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by r, g) as m from x) where m > 1
  ) group by r
), m as (
  select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, length(t) - length(translate(t, '{SYMBOLS}', '')) as n_symbols,
         len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words, len(list_filter(w, lambda x: x in ({_STOPS}))) as n_stop_words,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_capitals, length(t) - length(translate(t, '!', '')) as n_shouts, length(t) - length(translate(t, '.!?', '')) as n_stops,
         len(list_filter(l, lambda x: regexp_matches(ltrim(x), '^[-*•]'))) as n_bullets, len(list_filter(l, lambda x: regexp_matches(rtrim(x), '(\.\.\.|…)$'))) as n_cut_lines
  from d left join c using (r)
), b as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {' and '.join(_sql_rule(r) for r in RULES)} as kept from b
"""  # fmt: skip
