"""Quality rules as a ledger: each rule is evaluated once, its failure kept as a bit.

`ledger` stores measurements and failure bits. Policies are versioned sets of rules;
`apply_policy` and `ablations` only read the bits, so a changed policy never reads the
texts again.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.words import let, words_sql

#: Rule names in bit order, and the SQL over measurements that is true where a rule fails.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_dup_lines > 3 AND 10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "capitals": "2 * n_capitals > word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_capitals", "n_repeat_words")


@dataclass(frozen=True)
class Policy:
    """A named, versioned set of rules; a text is rejected if any of them fails."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[name] for name in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
FULL = Policy("full-1", tuple(RULES))


def repeat_words_sql(words: str, window: int = 3) -> str:
    """Words of an array that lie in a run of `window` words found twice or more.

    Each run's hash carries its position in the low bits; after one sort of plain
    numbers runs that may be equal are neighbours. Only these, which are few in a text
    without repeats, are then sorted by their words themselves, so the count is exact
    however short the hash gets in a long text.
    """
    parts = ", ".join(f"w[i + {k}]" for k in range(window))
    keys = f"sort_array(transform(sequence(0, size(w) - {window}), i -> shiftleft(xxhash64({parts}), b) | i))"
    near = "shiftrightunsigned(x, b) = shiftrightunsigned(get(s, {}), b)"
    maybe = f"filter(s, (x, k) -> coalesce({near.format('k - 1')}, false) or coalesce({near.format('k + 1')}, false))"
    run = f"transform(transform({maybe}, x -> int(x & (shiftleft(1L, b) - 1L))), i -> struct(array({parts}) as a, i as i))"
    same = "x.a = get(c, {}).a"
    twice = f"filter(c, (x, k) -> coalesce({same.format('k - 1')}, false) or coalesce({same.format('k + 1')}, false))"
    places = f"sort_array(transform({twice}, x -> x.i))"
    covered = (
        f"aggregate(transform(p, (x, k) -> if(k = 0, {window}L, least({window}L, bigint(x - get(p, k - 1))))), 0L, (a, y) -> a + y)"
    )
    body = let("length(bin(size(w)))", "b", let(keys, "s", let(f"sort_array({run})", "c", let(places, "p", covered))))
    return let(words, "w", f"if(size(w) < {window}, 0L, {body})")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `docs` with measurements and `fail_bits` (bit i: rule i of `RULES` fails).

    NULL and empty texts measure 0 and fail `few_words`. Columns of `docs` that bear a
    measurement's name are replaced. Rows are independent; nothing is shuffled.
    """
    symbols = f"length({text}) - length(regexp_replace({text}, '[#*$%&|<>]', ''))"
    capitals = f"length({text}) - length(regexp_replace({text}, '\\\\p{{Lu}}', ''))"
    lines = f"filter(split({text}, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    measured = (
        docs.withColumn("__words", F.expr(words_sql(text)))
        .withColumn("__lines", F.expr(lines))
        .withColumns(
            {
                "n_words": F.expr("size(__words)").cast("long"),
                "word_chars": F.expr("length(array_join(__words, ''))").cast("long"),
                "n_symbols": F.expr(f"coalesce({symbols}, 0)").cast("long"),
                "n_lines": F.expr("coalesce(size(__lines), 0)").cast("long"),
                "n_dup_lines": F.expr("coalesce(size(__lines) - size(array_distinct(__lines)), 0)").cast("long"),
                "n_capitals": F.expr(f"coalesce({capitals}, 0)").cast("long"),
                "n_repeat_words": F.expr(repeat_words_sql("__words")),
            }
        )
        .drop("__words", "__lines")
    )
    bits = " | ".join(f"if({test}, {BIT[name]}L, 0L)" for name, test in RULES.items())
    return measured.withColumn("fail_bits", F.expr(bits))


def apply_policy(kept: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with `kept` and `policy_version`."""
    return kept.withColumns(
        {
            "kept": F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0,
            "policy_version": F.lit(policy.version),
        }
    )


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of a policy: texts failing it, and texts that only it rejects.

    Works on the counts per bit pattern, of which there are at most 2 to the number of
    rules, whatever the number of texts.
    """
    mask = policy.mask
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(
        F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules])
    )
    return (
        patterns.select("bits", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
        .withColumn("policy_version", F.lit(policy.version))
    )
