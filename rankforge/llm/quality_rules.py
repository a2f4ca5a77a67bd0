"""Quality rules with host-level verdicts, in native expressions only.

Each text gets counts and a base verdict. Failures of each rule are aggregated
by host, and each host's rate is shrunk by the rule's beta prior, fitted to all
hosts (method of moments). A host is guilty of a rule if its posterior rate, less
``Z`` posterior standard deviations, is above both the prior's mean and
``MIN_RATE``: it fails most of its documents, and that can't be chance. The verdicts
of hosts are joined back to the documents: a guilty host keeps none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import cut

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
#: Words of a window that counts as repeated.
WINDOW = 8
#: The base rules, over the counts.
RULES = {"short": "n_words < 20", "repeat": "100 * n_repeat_words > 30 * n_words"}
#: Posterior standard deviations that must lie between a host's rate and the limit, and the least limit.
Z, MIN_RATE = 3.0, 0.5


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c))
    return text


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``.

    ``__tag`` is added as well: a filter that uses it isn't pushed below the
    counts, where it would work them out again for each array element.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0)
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(_without(x, _SPACES)) > 0)
    d = docs.withColumn("__w", F.transform(words, lambda x: F.xxhash64(x))).withColumn("__l", F.transform(lines, lambda x: F.xxhash64(x)))
    n = F.size("__w")
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(WINDOW)]))
    d = d.withColumn("__h", F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    # the windows sorted with their places; one beside an equal one is repeated
    pairs = F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), pairs))
    place = F.filter("__s", lambda x, k: F.coalesce(x["h"] == F.get("__s", k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("__s", k + 1)["h"], F.lit(False)))
    d = d.withColumn("__r", F.array_sort(F.transform(place, lambda x: x["i"])))
    covered = F.aggregate(F.transform("__r", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__r", k + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.select(
        *docs.columns,
        F.monotonically_increasing_id().alias("__tag"),
        n.cast("long").alias("n_words"),
        F.length(_without(text, _SPACES)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return d.withColumn("base_failed", F.expr(" or ".join(RULES.values())))


def host_verdicts(counted: DataFrame, host_col: str, z: float = Z, min_rate: float = MIN_RATE) -> DataFrame:
    """``host, n_docs``, then ``rate_<rule>`` (shrunk), and ``guilty``, the rules that the host is guilty of.

    With mean m and variance v of the hosts' rates, less the variance that
    counts of their size have by chance, a rule's prior weighs m(1-m)/v - 1
    documents (2 at least). Null hosts are one host.
    """
    hosts = counted.groupBy(F.col(f"`{host_col}`").alias("host")).agg(F.count("*").alias("n_docs"), *[F.count_if(F.expr(rule)).alias(f"k_{name}") for name, rule in RULES.items()])
    chance = F.avg(1 / F.col("n_docs"))
    moments = []
    for name in RULES:
        m = F.sum(f"k_{name}") / F.sum("n_docs")
        spread = F.greatest(F.var_pop(F.col(f"k_{name}") / F.col("n_docs")) - m * (1 - m) * chance, F.lit(1e-6))
        moments += [m.alias(f"m_{name}"), F.least(F.greatest(m * (1 - m) / spread - 1, F.lit(2.0)), F.lit(1e6)).alias(f"w_{name}")]
    shrunk = hosts.join(F.broadcast(hosts.agg(*moments)))  # one row: it may be broadcast
    rates, found = [], []
    for name in RULES:
        k, m, w = (F.col(f"{x}_{name}") for x in "kmw")
        rate = (k + m * w) / (F.col("n_docs") + w)
        least = rate - z * F.sqrt(rate * (1 - rate) / (F.col("n_docs") + w + 1))
        rates.append(rate.alias(f"rate_{name}"))
        found.append(F.when((least > min_rate) & (least > m), F.lit(name)))
    return shrunk.select("host", "n_docs", *rates, F.array_compact(F.array(*found)).alias("guilty"))


def _own(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").cast("string").alias("__host"), F.col(f"`{text_col}`").cast("string").alias("__text"))


def apply_quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", z: float = Z, min_rate: float = MIN_RATE) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_guilty`` and ``host_rate_<rule>``.

    One row for each input row. Words are runs of non-space (ASCII); a null
    text has none and fails. A document is kept unless it fails itself or its
    host is guilty; ``host_guilty`` names the rules, joined by a comma. Null hosts
    are one host; other columns are not read; an empty table gives an empty result.
    """
    counted = cut(base_counts(_own(docs, id_col, text_col, host_col), "__text").drop("__text", "__tag"))
    hosts = host_verdicts(counted, "__host", z, min_rate)
    # hosts may be many: Spark picks the join by their size, and splits a hot host's rows
    joined = counted.join(hosts, F.col("__host").eqNullSafe(F.col("host")), "left")
    kept = ~F.col("base_failed") & (F.size("guilty") == 0)
    rates = [F.col(f"rate_{name}").alias(f"host_rate_{name}") for name in RULES]
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.array_join("guilty", ",").alias("host_guilty"), *rates)


def drop_failed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", z: float = Z, min_rate: float = MIN_RATE) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Texts are counted twice, once for the hosts and once for the documents,
    rather than written in between: no copy of the corpus is made, and nothing but
    counts of hosts is exchanged. Nulls and empty tables are as in
    ``apply_quality_rules``; each of repeated rows is judged alike.
    """
    counted = base_counts(_own(docs, id_col, text_col, host_col), "__text").select("__host", "n_words", "n_repeat_words")
    guilty = cut(host_verdicts(counted, "__host", z, min_rate).where("size(guilty) > 0").select("host"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")  # no name in it can clash
    own = docs.select(row, F.col(f"`{host_col}`").cast("string").alias("__host"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    judged = base_counts(own, "__text").where("not base_failed and __tag >= 0").select("__row", "__host")
    if guilty.isEmpty():
        return judged.select("__row.*")
    return judged.join(guilty, F.col("__host").eqNullSafe(F.col("host")), "left_anti").select("__row.*")
