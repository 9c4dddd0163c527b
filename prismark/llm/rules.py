"""Quality rules as a ledger: every rule is evaluated once; policies and ablations read only its bits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismark.llm.common import add_columns, as_bytes, field, table

#: name -> (bit, SQL condition over the measurements that means failure). A bit keeps its meaning for ever;
#: a changed rule gets a new bit.
RULES: dict[str, tuple[int, str]] = {
    "too_few_words": (0, "n_words < 10"),
    "repeated_windows": (1, "100 * n_repeat_words > 20 * n_words"),
    "symbol_heavy": (2, "4 * n_symbols > n_words"),
    "too_many_words": (3, "n_words > 1000000"),
    "short_words": (4, "word_chars < 2 * n_words"),
    "long_words": (5, "word_chars > 20 * n_words"),
    "repeated_lines": (6, "n_dup_lines >= 4 and 10 * n_dup_lines > 5 * n_lines"),
    "few_distinct_words": (7, "n_words >= 100 and 20 * n_distinct < n_words"),
}


@dataclass(frozen=True)
class Policy:
    """A version of what counts: a document is kept when it fails none of these rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r][0] for r in self.rules)


BASE = Policy("base", ("too_few_words", "repeated_windows"))
STRICT = Policy("v1", ("too_few_words", "repeated_windows", "symbol_heavy", "short_words", "long_words", "repeated_lines", "few_distinct_words"))
POLICIES = (BASE, STRICT)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_distinct", "n_repeat_words")
_OTHER = bytes(c for c in range(256) if c not in b"#*$%&|<>")
_TAILS = bytes(range(0x80, 0xC0))


def measure(text: bytes, window: int = 5) -> tuple[int, ...]:
    """MEASURES of one whole text (UTF-8). Words are parted by the six ASCII white spaces."""
    words = text.split()
    n = len(words)
    chars = sum(map(len, words)) - len(text.translate(None, bytes(set(range(256)) - set(_TAILS))))
    lines = [x for x in text.split(b"\n") if x.split()]
    repeated = 0
    if n > window:
        grams = list(zip(*(words[i:] for i in range(window)), strict=False))
        if len(set(grams)) < len(grams):
            seen: dict[tuple, int] = {}
            twice = [False] * len(grams)
            for i, g in enumerate(grams):
                first = seen.setdefault(g, i)
                if first != i:
                    twice[first] = twice[i] = True
            until = 0
            for i, hit in enumerate(twice):
                if hit:
                    repeated += i + window - max(i, until)
                    until = i + window
    return n, chars, len(text.translate(None, _OTHER)), len(lines), len(lines) - len(set(lines)), len(set(words)), repeated


def _measurer():
    def run(texts):
        rows = [measure(t) for t in as_bytes(texts)]
        return list(zip(*rows, strict=True))

    return run


def ledger(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with the measurements and failure_bits (long; bit i set: rule i failed), one pass over whole texts.

    Null and empty texts have no words and fail as too short. Very long texts are measured whole, one at a time.
    Repeated rows are measured alike. An empty table stays empty. Columns of df pass through; one that is named
    like a measurement or failure_bits is replaced.
    """
    measured = add_columns(df, [text], [field(m, "long") for m in MEASURES], _measurer, keep)
    bits: Column = F.lit(0).cast("long")
    for bit, failed in RULES.values():
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("failure_bits", bits)


def passes(policy: Policy, bits: str = "failure_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def patterns(led: DataFrame) -> DataFrame:
    """How many documents show each pattern of failures: at most 2 to the number of rules, from partial sums."""
    return led.groupBy("failure_bits").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"))


def ablations(counted: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """For each policy and rule of it, from patterns() alone: how many documents the policy rejects, how many fail
    the rule, how many only this rule rejects, and how many are kept once it is left out.

    No text is read again. Rules of a policy that no document fails have zeros; an empty ledger gives zeros.
    """
    rows = [(p.version, r, p.mask, 1 << RULES[r][0]) for p in policies for r in p.rules]
    one = lambda p, r, m, b: F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit"))
    each = counted.select("failure_bits", "n_docs", F.explode(F.array(*[one(*x) for x in rows])).alias("x")).select("failure_bits", "n_docs", "x.*")
    masked = F.col("failure_bits").bitwiseAND(F.col("mask"))
    total = lambda cond: F.sum(F.when(cond, F.col("n_docs")).otherwise(0))
    sums = each.groupBy("policy", "rule").agg(
        total(masked != 0).alias("rejected"), total(F.col("failure_bits").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        total(masked == F.col("bit")).alias("only_this"), total(masked.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without"),
    )
    asked = counted.sparkSession.createDataFrame([r[:2] for r in rows], "policy string, rule string")
    return asked.join(sums, ["policy", "rule"], "left").select("policy", "rule", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("rejected", "failed", "only_this", "kept_without")])


def op1_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = ledger(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(BASE)).alias("base_failed"), (passes(BASE) & passes(STRICT)).alias("kept"),
        "n_lines", "n_distinct", "failure_bits", F.lit(STRICT.version).alias("policy"),
    )


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablations(patterns(ledger(table(spark, sf_dir, "documents"), keep=["doc_id"])))


_W = r"[^\x20\x09-\x0D]+"
OP1_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, regexp_extract_all(t, '{_W}') as w from d),
g as (select rid, i, list_aggregate(w[i:i+4], 'string_agg', ' ') as g from (select rid, w, unnest(range(1, len(w) - 3)) as i from w)),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from g) where c > 1),
n as (select rid, count(distinct i + k) as n from r, (select unnest(range(0, 5)) as k) group by rid),
l as (select rid, count(*) as n_lines, count(*) - count(distinct l) as n_dup from (select rid, unnest(string_split(t, chr(10))) as l from d) where regexp_matches(l, '{_W}') group by rid),
m as (
  select doc_id, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup, 0) as n_dup_lines, coalesce(n, 0) as n_repeat_words,
    coalesce(n_lines, 0) as n_lines, len(list_distinct(w)) as n_distinct
  from d join w using (rid) left join l using (rid) left join n using (rid)),
b as (select *, {" + ".join(f"case when {c} then {1 << bit} else 0 end" for bit, c in RULES.values())} as bits from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, (bits & {BASE.mask}) <> 0 as base_failed, (bits & {BASE.mask | STRICT.mask}) = 0 as kept,
  n_lines::bigint as n_lines, n_distinct::bigint as n_distinct, bits::bigint as failure_bits, '{STRICT.version}' as policy
from b"""

ABLATION_SQL = f"""
with x as (select failure_bits as f from ({OP1_SQL})),
p(policy, rule, mask, bit) as (values {", ".join(f"('{p.version}', '{r}', {p.mask}, {1 << RULES[r][0]})" for p in POLICIES for r in p.rules)})
select policy, rule, count(*) filter (where f & mask <> 0)::bigint as rejected, count(*) filter (where f & bit <> 0)::bigint as failed,
  count(*) filter (where f & mask = bit)::bigint as only_this, count(*) filter (where (f & mask) & ~bit = 0)::bigint as kept_without
from p left join x on true group by policy, rule"""
