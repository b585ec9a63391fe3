"""Quality rules with cutoffs whose false rejections are bounded.

Rules reject a document where a measure of its text lies above a cutoff.  The
cutoffs are chosen for each stratum (a column, ``lang`` by default) from
labelled documents, in two disjoint shares of them:

* one share proposes: for each of :data:`LEVELS` and each rule the smallest
  cutoff that at most this share of its good documents exceeds;
* the other share, the holdout, tests the proposals of a stratum from the
  laxest on.  A proposal is certified if the exact (Clopper-Pearson) upper
  bound of its share of rejected good documents is at most ``risk``, and all
  laxer ones are certified.  The bounds hold at ``error`` divided by the number
  of strata (Bonferroni), within a stratum the fixed order needs no further
  correction.  So with a probability of 1 - ``error`` no certified proposal of
  any stratum rejects more than ``risk`` of the good documents.

Of a stratum's certified proposals that which rejects most of the proposing
share's bad documents decides, the laxest of equals.  A stratum without a
certified proposal rejects by the base rule alone.

All is done by DataFrame functions; what is gathered from the labelled rows
are counts by stratum, rule and measure.

Defined results: null and empty texts have no words and fail the base rule; a
null stratum is a stratum of its own; labels that are null or belong to no
document are left out, repeated rows count as often as they are there; an
empty table gives no rows.  Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARACTERS = " \t\n\x0b\f\r"
LEVELS = (0.0, 0.001, 0.002, 0.005, 0.01)
RISK, ERROR = 0.02, 0.05
WINDOW = 5
SMALL = 100_000  # rows of cutoffs that are sent to the executors


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def recurring(items: Column) -> Column:
    """Places, in order, of the (value, place) pairs whose value another one has too."""

    def twice(p: Column) -> Column:
        same = lambda k, j: F.coalesce(F.get(p, j)["v"] == F.get(p, k)["v"], F.lit(False))
        return F.transform(F.filter(p, lambda x, k: same(k, k - 1) | same(k, k + 1)), lambda x: x["i"])

    return F.sort_array(bound(F.sort_array(items), twice))


def repeated(words: Column) -> Column:
    """How many words lie in windows of :data:`WINDOW` words that are found twice or more.

    Most texts have no two windows of one hash and need no more.  In others
    the windows of such hashes are compared as texts; of those with an equal
    one each adds the words up to the next.
    """
    window = lambda i: [F.get(words, i + k) for k in range(WINDOW)]
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*window(i)))
    by_hash = lambda found: recurring(F.transform(found, lambda h, i: F.struct(h.alias("v"), i.alias("i"))))
    by_text = lambda at: recurring(F.transform(at, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("v"), i.alias("i"))))

    def covered(at: Column) -> Column:
        each = F.transform(at, lambda x, k: F.least(F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    none = F.lit(0).cast("long")
    several = lambda found: F.when(F.size(F.array_distinct(found)) < F.size(found), bound(bound(by_hash(found), by_text), covered)).otherwise(none)
    return F.when(F.size(words) > WINDOW, bound(hashes, several)).otherwise(none)


def measures(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with the base counts, ``base_failed`` and ``values``: the measure of each rule, whole numbers."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANK_CHARACTERS)) != "")
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    by_words = bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated(w).alias("n_repeat_words")))
    by_lines = bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    rows = docs.select(*keep, by_words.alias("__w"), by_lines.alias("__l"), left(r"[^#*$%&|<>]+").alias("n_symbols"), left(r"[^\p{Lu}]+").alias("__upper"), left(r"[\p{L}\x20\x09-\x0D]+").alias("__marks"))
    rows = rows.select(*keep, "__w.*", "__l.*", "n_symbols", "__upper", "__marks")
    share = lambda part, whole, scale=1000: F.floor(scale * F.col(part) / F.greatest(F.col(whole), F.lit(1))).cast("long")
    values = F.map_from_arrays(
        F.array(*map(F.lit, RULES)),
        F.array(share("n_symbols", "n_words"), share("__marks", "word_chars"), share("__upper", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("word_chars", "n_words", 10), share("n_words", "word_chars")),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), values.alias("values"))


#: symbols a word, marks and capitals a character, equal lines, repeated words, long and short words
RULES = ("symbols", "marks", "capitals", "equal_lines", "repeats", "long_words", "short_words")


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for positive numbers: Stirling's series ten places on."""
    z = x + 10.0
    back = F.lit(0.0)
    for k in range(10):
        back = back + F.log(x + float(k))
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - back


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """Probability of at most ``k`` of ``n``, for k / n <= p: the largest term and what the smaller ones are
    of it; terms beyond 40 standard deviations and 200 more are below double precision."""
    k, n = k.cast("double"), n.cast("double")
    peak = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(p) + (n - k) * F.log1p(-p)
    steps = F.least(k, 40 * F.sqrt(n * p) + 200).cast("long")
    term = lambda a, j: a["term"] * (k - j + 1) * (1 - p) / ((n - k + j) * p)
    sums = F.aggregate(F.sequence(F.lit(1).cast("long"), steps), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), lambda a, j: F.struct(term(a, j).alias("term"), (a["sum"] + term(a, j)).alias("sum")), lambda a: a["sum"])
    return F.exp(peak) * F.when(steps >= 1, sums).otherwise(1.0)


def upper_bound(k: Column, n: Column, error: Column, most: float) -> Column:
    """Clopper-Pearson upper bound of a share at confidence 1 - ``error``, halving towards the share at which
    ``k`` or fewer have the probability ``error``; 1 where it is above ``most``."""
    low = F.greatest(k / n, F.lit(1e-15))
    halved = lambda a, mid: F.when(binomial_tail(k, n, mid) <= error, F.struct(a["low"].alias("low"), mid.alias("high"))).otherwise(F.struct(mid.alias("low"), a["high"].alias("high")))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(45)), F.struct(low.alias("low"), F.lit(most).alias("high")), lambda a, _: bound((a["low"] + a["high"]) / 2, lambda mid: halved(a, mid)), lambda a: a["high"])
    return F.when((k / n < most) & (binomial_tail(k, n, F.lit(most)) <= error), found).otherwise(1.0)


def proposals(rows: DataFrame) -> DataFrame:
    """``stratum, step, cutoffs``: for each of :data:`LEVELS` the smallest cutoff of each rule that at most this share of the good rows exceeds."""
    counts = rows.filter("good").select("stratum", F.explode("values").alias("rule", "value")).groupBy("stratum", "rule", "value").agg(F.count("*").alias("n"))
    by = Window.partitionBy("stratum", "rule")
    counts = counts.withColumn("above", F.sum("n").over(by.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1))).withColumn("all", F.sum("n").over(by))
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(x).alias("level")) for i, x in enumerate(LEVELS)])).alias("l")
    fit = counts.select("stratum", "rule", "value", F.coalesce("above", F.lit(0)).alias("above"), "all", levels).filter(F.col("above") <= F.floor(F.col("l.level") * F.col("all")))
    cutoffs = fit.groupBy("stratum", "rule", F.col("l.step").alias("step")).agg(F.min("value").alias("cutoff"))
    return cutoffs.groupBy("stratum", "step").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule", "cutoff")))).alias("cutoffs"))


def small(df: DataFrame) -> DataFrame:
    """A table for a broadcast join, if its size allows it."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def exceeds(values: Column, cutoffs: Column) -> Column:
    """Whether the measure of any rule lies above its cutoff."""
    over = None
    for rule in RULES:
        one = values[rule] > cutoffs[rule]
        over = one if over is None else over | one
    return over


def certified(labelled: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``stratum, step, cutoffs, n, rejected, bound, caught, certified`` of all proposals.

    ``labelled`` has ``stratum``, ``good``, ``proposes`` and ``values``.
    """
    offered = written(proposals(labelled.filter("proposes")), "proposals")
    over = labelled.join(small(offered), "stratum").withColumn("over", exceeds(F.col("values"), F.col("cutoffs")))
    held, mine = ~F.col("proposes") & F.col("good"), F.col("proposes") & ~F.col("good")
    counts = over.groupBy("stratum", "step").agg(F.count_if(held).alias("n"), F.count_if(held & F.col("over")).alias("rejected"), F.count_if(mine & F.col("over")).alias("caught"))
    strata = offered.select("stratum").distinct().count()
    each = F.lit(error / max(1, strata))
    tested = counts.withColumn("bound", F.when(F.col("n") > 0, upper_bound(F.col("rejected"), F.col("n"), each, risk)).otherwise(1.0))
    so_far = F.max("bound").over(Window.partitionBy("stratum").orderBy("step"))
    return tested.withColumn("certified", so_far <= risk).join(offered, ["stratum", "step"])


def judge(found: DataFrame, tested: DataFrame) -> DataFrame:
    """Add ``kept``: neither the base rule nor the chosen cutoffs of the stratum reject the document."""
    best = F.max_by("cutoffs", F.struct("caught", (-F.col("step")).alias("s")))
    chosen = written(tested.filter("certified").groupBy("stratum").agg(best.alias("cutoffs")), "cutoffs")
    rows = found.join(small(chosen), "stratum", "left")
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(exceeds(F.col("values"), F.col("cutoffs")), F.lit(False)))


def apply(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Every document's counts and ``kept``.  Of the labelled rows those whose id has a first MD5 digit of
    0 to 3 propose and those of 4 to b are the holdout; the rest stays unused, for measuring what the rules do."""
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("")).alias("stratum"), F.col(text_col).alias("text"))
    found = written(measures(docs, keep=("id", "stratum")), "measures")
    digit = F.substring(F.md5(F.col("id").cast("string")), 1, 1)
    known = labels.select(F.col(id_col).alias("id"), (F.col(label_col) == 1).alias("good")).filter("id is not null and good is not null")
    labelled = written(found.filter("not base_failed").select("id", "stratum", "values").join(known, "id").filter(digit < "c").select("stratum", "values", "good", (digit < "4").alias("proposes")), "labelled")
    return judge(found, certified(labelled, risk, error)).withColumnRenamed("id", id_col)
