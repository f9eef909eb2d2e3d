"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document: the ledger, a written table, keeps the measurements and one long of
failure bits. Policies are versioned sets of rules; applying one, or asking what it would keep without one of its rules,
only reads the stored bits. Built-in functions only; nothing is shuffled but the one-row ablation counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutprox.session import cut

#: Words are what lies between space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
REPEAT = 8


@dataclass(frozen=True)
class Rule:
    """``fails``: SQL over the measurements, never null."""

    bit: int
    name: str
    fails: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "capitals", "10 * n_upper > 3 * n_letters"),
    Rule(4, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(5, "word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule(6, "no_letters", "n_letters = 0"),
)
BIT = {r.name: r.mask for r in RULES}
#: A policy is a version and the rules it holds documents to; old versions stay as they were.
POLICIES = {
    "base-1": BIT["few_words"] | BIT["repeated_words"],
    "prose-1": BIT["few_words"] | BIT["repeated_words"] | BIT["symbols"] | BIT["capitals"] | BIT["repeated_lines"] | BIT["word_length"] | BIT["no_letters"],
}
CURRENT = "prose-1"


def _once(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)`` with the value computed a single time however often it is used."""
    return F.transform(F.array(value), use)[0]


def _repeated_places(hashes: Column) -> Column:
    """Places, in order, of the elements that occur twice or more."""
    tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twins(s: Column) -> Column:
        m = F.size(s) - 1
        both = F.zip_with(F.slice(s, 1, m), F.slice(s, 2, m), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
        return F.sort_array(F.array_distinct(F.flatten(both)))

    return _once(tagged, twins)


def _covered(places: Column, width: int) -> Column:
    """Number of positions under windows of ``width`` that start at the sorted ``places``."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda acc, p: F.struct((acc["n"] + width - F.greatest(F.lit(0), acc["end"] - p)).alias("n"), (p.cast("long") + width).alias("end"))
    return F.aggregate(places, start, step, lambda acc: acc["n"])


def repeat_words(words: Column, width: int = REPEAT) -> Column:
    """Words under windows of ``width`` words that occur twice or more (windows are compared by a 64-bit hash within one text)."""
    n = F.size(words) - (width - 1)
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, width)))
    some = _once(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(_repeated_places(h), width)))
    return F.when(n < 2, F.lit(0).cast("long")).otherwise(some)


def measurements(text: Column) -> Column:
    """A struct of everything the rules look at. Words and lines are cut out once and used inside one lambda, so that no rewriting of the plan can repeat that."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, SPACES), "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, " \t\n\x0b\f\r", "") != "")
    return _once(
        F.struct(t.alias("t"), words.alias("w"), lines.alias("l")),
        lambda s: F.struct(
            F.size(s["w"]).cast("long").alias("n_words"),
            F.length(F.translate(s["t"], " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
            (F.length(s["t"]) - F.length(F.translate(s["t"], SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(s["l"]) - F.size(F.array_distinct(s["l"]))).cast("long").alias("n_dup_lines"),
            repeat_words(s["w"]).alias("n_repeat_words"),
            F.size(s["l"]).cast("long").alias("n_lines"),
            F.regexp_count(s["t"], F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.regexp_count(s["t"], F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        ),
    )


def ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, every measurement, and ``failed``: the bits of the rules that the row fails. Written once, read from then on.

    A null text has no words, symbols or lines. Rows are judged one by one: ties, repeated rows and null ids change
    nothing, an empty table gives an empty ledger, and a text of any length is one cell.
    """
    measured = docs.select(*[F.col(c).alias(f"__{c}") for c in keep], measurements(F.col(text_col)).alias("m"))
    measured = measured.select(*[F.col(f"__{c}").alias(c) for c in keep], "m.*")
    bits = [F.when(F.expr(r.fails), F.lit(r.mask)).otherwise(F.lit(0)).cast("long") for r in RULES]
    return cut(measured.withColumn("failed", sum(bits[1:], bits[0])))


def passes(policy: str = CURRENT, failed: Column | str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(POLICIES[policy])) == 0 if isinstance(failed, str) else failed.bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(entries: DataFrame) -> DataFrame:
    """For each policy and each of its rules: rows that fail the rule, and rows that this rule alone keeps out.

    One pass of bitwise aggregation over the ledger: ``policy, rule, n_failed, n_only, n_kept``.
    """
    asked = [(p, r) for p, mask in POLICIES.items() for r in RULES if r.mask & mask]
    hit = lambda mask, want: F.sum(F.when(F.col("failed").bitwiseAND(F.lit(mask)) == want, 1).otherwise(0))
    counts = entries.agg(*[F.struct(hit(r.mask, r.mask).alias("n_failed"), hit(POLICIES[p], r.mask).alias("n_only"), hit(POLICIES[p], 0).alias("n_kept")).alias(f"{p}/{r.name}") for p, r in asked])
    rows = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r.name).alias("rule"), F.col(f"`{p}/{r.name}`").alias("c")) for p, r in asked])
    zero = lambda c: F.coalesce(F.col(f"x.c.{c}"), F.lit(0)).alias(c)
    return counts.select(F.explode(rows).alias("x")).select("x.policy", "x.rule", zero("n_failed"), zero("n_only"), zero("n_kept"))


def verdicts(docs: DataFrame, policy: str = CURRENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed``, a row for each row."""
    return ledger(docs, text_col, (id_col,)).select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base-1")).alias("base_failed"), (passes("base-1") & passes(policy)).alias("kept"), "failed",
    )


def keep_good(docs: DataFrame, policy: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows that pass the base rules and the policy, columns as given.

    The ledger holds each row beside its bits. A null or empty text fails; null ids, ties and repeated rows are judged one
    by one; an empty table gives none.
    """
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text_col).alias("body"))
    return ledger(whole, "body", ("row",)).filter(passes("base-1") & passes(policy)).select("row.*")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8
), keyed AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS s FROM win
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM keyed) WHERE c > 1
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(regexp_extract_all(t, '\p{Lu}')) AS BIGINT) AS n_upper, CAST(len(regexp_extract_all(t, '\p{L}')) AS BIGINT) AS n_letters
  FROM w LEFT JOIN cover USING (doc_id)
), k AS (
  SELECT *, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM m
), b AS (
  SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
       + 8 * (10 * n_upper > 3 * n_letters)::INT + 16 * (2 * n_dup_lines > n_lines)::INT
       + 32 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT + 64 * (n_letters = 0)::INT AS BIGINT) AS failed FROM k
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, failed = 0 AS kept, failed FROM b
"""

ABLATIONS = f"""
WITH entries AS ({ORACLE}), asked AS (
  SELECT * FROM (VALUES {", ".join(f"('{p}', '{r.name}', {mask}, {r.mask})" for p, mask in POLICIES.items() for r in RULES if r.mask & mask)}) AS v(policy, rule, policy_bits, rule_bit)
)
SELECT policy, rule, CAST(count(*) FILTER (WHERE failed & rule_bit = rule_bit) AS BIGINT) AS n_failed,
       CAST(count(*) FILTER (WHERE failed & policy_bits = rule_bit) AS BIGINT) AS n_only,
       CAST(count(*) FILTER (WHERE failed & policy_bits = 0) AS BIGINT) AS n_kept
FROM asked LEFT JOIN entries ON true GROUP BY policy, rule
"""
