"""Quality rules: a table of thresholds compiled into Spark expressions, without user functions.

Measures of a text (null counts as empty): words, their characters, symbols, lines with a word,
lines equal to an earlier one, stop words, and words in 5-word windows that are found twice or
more. A rule compares one measure with a share of another, in integers, so that no rounding
decides: it rejects where ``100 * measure`` is over (or under) ``percent * base``.

Defined cases: null and empty texts have zero words and fail the length rule; a measure over an
empty base never fails a share rule by division; repeated rows are judged alike, each for itself;
an empty table gives an empty one; further columns of the input are kept or ignored, never read.
Within one text, equal windows are told apart by a 64-bit hash of their five words' hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_or_empty

# Frequent words of the four languages of the corpus.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were which will with you "
    "au avec ce cette dans de des du elle en est et il la le les mais ne ou par pas pour qui que se sont sur un une "
    "aber als auch auf aus bei das dem den der die ein eine es für hat ich ist mit nicht sich sie sind und von war zu "
    "al como con del el ella es la las lo los más no o para pero por que se sin su un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """Rejects where 100 * measure is over percent * base (or under it, for side='under'); at_least: words from which it applies."""

    name: str
    measure: str
    side: str
    percent: int
    base: str
    at_least: int = 0

    def rejects(self) -> Column:
        left, right = F.col(self.measure) * 100, F.col(self.base) * self.percent
        hit = left > right if self.side == "over" else left < right
        return hit & (F.col("n_words") >= self.at_least) if self.at_least else hit

    def sql(self) -> str:
        return f"(100 * {self.measure} {'>' if self.side == 'over' else '<'} {self.percent} * {self.base}" + (f" AND n_words >= {self.at_least})" if self.at_least else ")")


#: The length floor and the cap on repeated windows: failing these is base_failed.
BASE_RULES = (
    Rule("too_short", "n_words", "under", 1000, "one"),
    Rule("repeated_windows", "n_repeat_words", "over", 20, "n_words"),
)
#: The thresholds of production.
RULES = (
    Rule("symbols", "n_symbols", "over", 20, "n_words"),
    Rule("repeated_lines", "n_dup_lines", "over", 50, "n_lines"),
    Rule("words_too_long", "word_chars", "over", 2000, "n_words"),
    Rule("words_too_short", "word_chars", "under", 150, "n_words"),
    Rule("no_stop_words", "n_stop_words", "under", 1, "n_words", 100),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")
WINDOW = 5


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns (all but those named like a measure, if keep is None) with the MEASURES. Steps that a lambda reads are columns of their own: then each is worked out once a row."""
    names = [c for c in docs.columns if c not in MEASURES] if keep is None else list(keep)
    if {*names} & {*MEASURES}:
        raise ValueError(f"{MEASURES} are the names of the results")
    at = "__t"
    own = lambda *more: [*(F.col(f"`{c}`") for c in names), *more]
    base = docs.select(*own(text_or_empty(f"`{text}`").alias(at)))
    split = base.select(
        *own(
            F.regexp_extract_all(at, F.lit(WORD), F.lit(0)).alias("__words"),
            F.filter(F.split(at, "\n", -1), lambda x: x.rlike(WORD)).alias("__lines"),
            F.length(F.regexp_replace(at, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        )
    )
    hashed = split.select(
        *own(
            "n_symbols",
            F.size("__words").cast("long").alias("n_words"),
            F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
            F.size("__lines").cast("long").alias("n_lines"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
            F.size(F.filter("__words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.transform("__words", lambda w: F.xxhash64(w)).alias("__h"),
        )
    )
    plain = ["n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines", "n_stop_words"]
    windows = hashed.select(
        *own(
            *plain,
            F.when(
                F.size("__h") > WINDOW,
                F.transform(F.sequence(F.lit(0), F.size("__h") - WINDOW), lambda i: F.xxhash64(*(F.get("__h", i + k) for k in range(WINDOW)))),
            ).alias("__w"),
        )
    )
    placed = windows.select(
        *own(
            *plain,
            F.when(
                F.size("__w") > F.size(F.array_distinct("__w")),
                F.array_sort(F.transform("__w", lambda x, i: F.struct(x.alias("k"), i.alias("i")))),
            ).alias("__p"),
        )
    )

    def twice(x: Column, i: Column) -> Column:
        near = lambda j: F.get("__p", j)["k"] == x["k"]
        return F.coalesce(near(i - 1), F.lit(False)) | F.coalesce(near(i + 1), F.lit(False))

    places = F.array_sort(F.transform(F.filter("__p", twice), lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["total"] + i + WINDOW - F.greatest(i, a["end"])).alias("total"), (i + WINDOW).alias("end")),
        lambda a: a["total"],
    )
    # behind a generator the measures are columns: a filter on them isn't written out in all that made them
    made = F.struct(*plain, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return placed.select(*own(F.explode(F.array(made)).alias("__made"))).select(*own("__made.*"))


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The table of rules as one projection: base_failed, kept, and the names of the rules that reject."""
    ruled = measured.withColumn("one", F.lit(1).cast("long"))
    reasons = F.array_compact(F.array(*(F.when(r.rejects(), F.lit(r.name)) for r in (*BASE_RULES, *rules))))
    failed = lambda some: F.exists(F.array(*(r.rejects() for r in some)), lambda x: x)
    return ruled.select(*measured.columns, failed(BASE_RULES).alias("base_failed"), (~failed((*BASE_RULES, *rules))).alias("kept"), F.array_join(reasons, ",").alias("rejected_by"))


def quality_filter(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that no rule rejects, with the columns they had."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(f"`{text}`").alias("__text"))
    judged = judge(measure(packed, "__text", ("__row",)), rules)
    return judged.where("kept").select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(measure(docs, keep=("doc_id",))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "rejected_by")


def oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    either = lambda some: " OR ".join(r.sql() for r in some)
    names = ", ".join(f"CASE WHEN {r.sql()} THEN '{r.name}' END" for r in (*BASE_RULES, *RULES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM w),
five AS (SELECT r, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS g, lead(x, 4) OVER o AS last FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
counted AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM five WHERE last IS NOT NULL),
cover AS (SELECT r, count(DISTINCT i + k) AS n FROM counted, range(0, 5) AS t(k) WHERE c > 1 GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(ws, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words, 1 AS one FROM w LEFT JOIN cover USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({either(BASE_RULES)}) AS base_failed,
  NOT ({either((*BASE_RULES, *RULES))}) AS kept, n_lines, n_stop_words, concat_ws(',', {names}) AS rejected_by FROM m"""
