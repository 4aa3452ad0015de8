"""URL filter: rules first, then a character language-model ratio. DataFrame functions only.

Rules name a host suffix and a path prefix. The distinct URLs that a rule allows or blocks train two character models, one
of accepted and one of rejected URLs: Markov models of variable order, up to `ORDER`, over 40 symbols. A context is kept if
both models together saw it `LEAST` times; each model's probability of a symbol after a context is its count there, smoothed
by its probability after the context one symbol shorter (`MU` counts of that). A URL's score is the mean over its
symbols, each after its longest kept context, of the log-probability difference; it is allowed from the threshold on
that separates labelled URLs best which the models did not see (least sum of the two error rates, found on a histogram
of `BINS` bins).

All labelled URLs are used, and all contexts seen often enough: four fifths of the URLs (by hash) give the counts, the
other fifth the threshold; if that fifth lacks a kind, all URLs give both. The model is a table with a row for each distinct
gram of ORDER + 1 symbols in any URL (N ** (ORDER + 1) at most), and never passes through the driver. Counts of shorter
grams are sums of those of longer ones. URLs meet it by a join on their grams: grams that make up more than one in
`HOT_SHARE` of all are broadcast (so HOT_SHARE at most), all others are shuffled. Differences are summed as multiples of 1 / `UNIT`,
so that a sum doesn't depend on its order and reruns agree.

Null URLs and URLs without `://` have an empty host and path and fit no rule; the models judge them (an empty text
scores 0). Without any labelled URL, or of one kind only, scores and threshold are 0: all that no rule blocks is
allowed. Repeated rows get a result each. Other columns are dropped, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols 1 to 38 of the models; 0 comes before the first, 39 is any other character. Digits count as 0.
SYMBOLS = LOWER + "0/.-_?=&#%:~"
N = 40
ORDER, MU, LEAST = 4, 4.0, 4
BINS = 2000
REACH = 4.0
#: Grams that make up more than one in HOT_SHARE of all are broadcast; symbols of URLs for a task; parts of 1 in a difference.
HOT_SHARE, TASK_SYMBOLS, UNIT = 10_000, 2_000_000, 1 << 32


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The name of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        out = F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.name)).otherwise(out)
    return out


def symbols(url: Column) -> Column:
    """The URL's symbols as an array of numbers, ORDER zeros put before."""
    plain = F.translate(F.coalesce(F.lower(url), F.lit("")), "123456789", "000000000")
    chars = F.filter(F.split(plain, ""), lambda c: c != "")
    codes = F.transform(chars, lambda c: F.when(F.instr(F.lit(SYMBOLS), c) > 0, F.instr(F.lit(SYMBOLS), c)).otherwise(N - 1))
    return F.concat(F.array_repeat(F.lit(0), ORDER), codes)


def grams(code: Column) -> Column:
    """For each symbol the number of it and the ORDER before it, the last digit to the base N being its own."""

    def number(i: Column) -> Column:
        out = F.lit(0).cast("long")
        for k in range(ORDER + 1):
            out = out * N + F.get(code, i + k)
        return out

    return F.when(F.size(code) > ORDER, F.transform(F.sequence(F.lit(0), F.size(code) - ORDER - 1), number)).otherwise(F.array().cast("array<long>"))


def differences(counts: DataFrame, both: bool) -> DataFrame:
    """gram, n and the difference (in parts of 1 / UNIT) of each row of counts: gram (of ORDER + 1 symbols), n, and how often accepted (a) and rejected (r) URLs have it. Without URLs of both kinds all differences are 0."""
    levels = [counts.select("gram", "a", "r")]
    for k in range(ORDER, 0, -1):  # of the grams of order k - 1
        levels.insert(0, levels[0].groupBy((F.col("gram") % F.lit(N**k)).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
    n = levels[0].agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(f"n_{x}") for x in ("a", "r")])
    now = levels[0].crossJoin(F.broadcast(n)).select("gram", *[((F.col(x) + 1.0) / (F.col(f"n_{x}") + float(N - 1))).alias(f"p_{x}") for x in ("a", "r")])
    for k in range(1, ORDER + 1):
        # of each context, the counts of all its symbols; a context has N grams at most
        context = Window.partitionBy(F.floor(F.col("gram") / N))
        own = levels[k].select("gram", "a", "r", (F.col("gram") % F.lit(N**k)).alias("shorter"), F.sum("a").over(context).alias("all_a"), F.sum("r").over(context).alias("all_r"))
        shorter = now.select(F.col("gram").alias("shorter"), F.col("p_a").alias("q_a"), F.col("p_r").alias("q_r"))
        own = own.join(F.broadcast(shorter) if k < ORDER else shorter, "shorter")  # N ** 3 rows at most, but for the last
        kept = F.col("all_a") + F.col("all_r") >= LEAST
        now = own.select("gram", *[F.when(kept, (F.col(x) + MU * F.col(f"q_{x}")) / (F.col(f"all_{x}") + MU)).otherwise(F.col(f"q_{x}")).alias(f"p_{x}") for x in ("a", "r")])
    difference = F.round((F.log("p_a") - F.log("p_r")) * float(UNIT)).cast("long") if both else F.lit(0).cast("long")
    return now.select("gram", difference.alias("difference")).join(counts.select("gram", "n"), "gram")


def mean_differences(found: DataFrame, values: DataFrame) -> DataFrame:
    """u and the mean difference of its grams. found: u, gram; values: gram, n, difference, for all grams found."""
    most = (values.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE
    hot = F.broadcast(values.where(F.col("n") > most).select("gram", "difference"))
    cold = values.where(F.col("n") <= most).select("gram", "difference")
    near = found.join(hot, "gram").select("u", "difference")
    far = found.join(hot.select("gram"), "gram", "left_anti").join(cold, "gram").select("u", "difference")
    return near.unionByName(far).groupBy("u").agg((F.sum("difference") / F.count(F.lit(1)) / float(UNIT)).alias("score"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row with `cut`: the lowest bin border at which the share of accepted URLs below and of rejected ones not below sum to least. scored: score, good."""
    width = 2 * REACH / BINS
    at = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + REACH) / width)))
    bins = scored.groupBy(at.alias("bin")).agg(F.count_if("good").alias("a"), F.count_if(~F.col("good")).alias("r"))
    whole, upto = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    below_a, below_r = F.coalesce(F.sum("a").over(upto), F.lit(0)), F.coalesce(F.sum("r").over(upto), F.lit(0))
    n_a, n_r = F.sum("a").over(whole), F.sum("r").over(whole)
    wrong = F.when((n_a > 0) & (n_r > 0), below_a / n_a + 1 - below_r / n_r)
    cut = bins.select("bin", wrong.alias("wrong")).where("wrong is not null")
    return cut.agg(F.coalesce(F.min_by("bin", F.struct("wrong", "bin")) * width - REACH, F.lit(0.0)).alias("cut"))


def url_filter(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule, verdict (allow or block), score and cut of each page."""
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    tasks = max(1, min(-(-int(base.agg(F.sum(F.length("url").cast("long"))).first()[0] or 0) // TASK_SYMBOLS), 100_000))
    host, path = host_and_path(F.col("url"))
    base = base.withColumns({"host": host, "path": path}).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    allowed = [r.name for r in rules if r.action == "allow"]
    base = base.withColumn("good", F.when(F.col("rule").isNotNull(), F.col("rule").isin(allowed)))
    urls = base.where("url is not null").select("url", "good").distinct().repartition(tasks, "url")
    urls = cut_lineage(urls.select("url", "good", (F.pmod(F.xxhash64(F.lit(5), "url"), F.lit(5)) == 0).alias("aside"), F.monotonically_increasing_id().alias("u")))
    kinds = {(r.good, r.aside) for r in urls.where("good is not null").groupBy("good", "aside").agg(F.count(F.lit(1))).collect()}
    apart = {(True, True), (False, True)} <= kinds
    both = len({good for good, aside in kinds if not (apart and aside)}) == 2
    codes = urls.select("u", "good", "aside", symbols(F.col("url")).alias("code"))  # a column of its own, as grams() refers to it for each symbol
    found = codes.select("u", "good", "aside", F.explode(grams(F.col("code"))).alias("gram"))
    fits = ~F.col("aside") if apart else F.lit(True)
    counts = cut_lineage(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.count_if(fits & F.col("good")).alias("a"), F.count_if(fits & ~F.col("good")).alias("r")))
    means = mean_differences(found.select("u", "gram"), cut_lineage(differences(counts, both)))
    scored = cut_lineage(urls.join(means, "u", "left").select("url", "good", "aside", F.coalesce("score", F.lit(0.0)).alias("score")))
    cut = threshold(scored.where(F.col("good").isNotNull() & (F.col("aside") if apart else F.lit(True))).select("good", "score")).scalar()
    score = F.coalesce("score", F.lit(0.0))
    out = base.join(scored.select("url", "score"), "url", "left").select("id", "host", "path", "rule", "good", score.alias("score")).withColumn("cut", cut)
    verdict = F.coalesce(F.col("good"), F.col("score") >= F.col("cut"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.when(verdict, "allow").otherwise("block").alias("verdict"), "score", "cut")


#: The rules of query op10.
RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]
