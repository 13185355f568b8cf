"""URL filter: rules first, then the ratio of two character language models. DataFrame functions only.

A rule names a host (with all its subdomains) and the start of a path; the
longest rule that fits decides. URLs that a rule decides are the labelled
ones: they teach a model of accepted and one of rejected URLs, which decide
the rest.

1. Each URL is written, in one scan of the table, as a narrow row: host, path,
   rule, label, and whether it is held out (by a hash of the URL).
2. A URL is its characters, ORDER marks before and one behind, each with the
   ORDER characters before it. Counts of these grams, by label and over all
   rows that are not held out, are a partly aggregated group-by; counts of all
   shorter contexts are sums over grams with the same end.
3. Variable-order Markov models with Witten-Bell smoothing: the probability
   behind a context of k characters leans on the one behind k - 1, by the
   number of different characters seen there; a context that was never seen
   leaves it as it is.
4. Every gram of the table has its difference of log probabilities, in whole
   millionths, so that sums do not depend on their order. A URL's score is
   their sum over its characters divided by their number, rounded down.
5. The cut comes from the held-out labelled URLs: scores in bins of BIN, the
   bin from which accepting best tells allowed from blocked ones (share of
   allowed accepted less share of blocked accepted), and half the way from it
   to the next lower bin in use. Without both labels the cut is 0.

Grams and scores meet in an equi-join; neither the models nor the counts pass
through the driver, only the number of different characters and the cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm.common import prepare, stash

ORDER = 4
BEFORE, BEHIND = "\x02", "\x03"
MILLION = 1_000_000
#: Width of the bins of scores, in millionths of a nat: some thousand bins at most.
BIN = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(verdict: str, name: str) -> Rule:
    host, slash, path = name.partition("/")
    return Rule(verdict, host, slash + path)


RULES = (rule("allow", "com/"), rule("block", "example.com/en/"), rule("allow", "www.example.com/en/"),
         rule("block", "net/es/"), rule("block", "net/fr/"))


def host_and_path(url: Column) -> list[Column]:
    """The host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return [F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER).alias("host"),
            F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path")]


def decided(rules: tuple[Rule, ...]) -> list[Column]:
    """rule (its name) and label (its verdict) of rows with host and path: the longest that fits,
    of equally long ones the one with the longer host, then the blocking one; else null."""
    first = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.verdict != "block", r.name))
    fits = [((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path)) for r in first]
    return [F.coalesce(F.lit(None).cast("string"), *[F.when(f, F.lit(getattr(r, what))) for f, r in zip(fits, first, strict=True)]).alias(alias)
            for what, alias in (("name", "rule"), ("verdict", "label"))]


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    """One row for each character of each URL: the character behind the ORDER ones before it."""
    chars = F.filter(F.split(F.coalesce("url", F.lit("")), ""), lambda c: c != "")
    marked = urls.select(*keep, F.concat(F.array_repeat(F.lit(BEFORE), ORDER), chars, F.array(F.lit(BEHIND))).alias("_marked"))
    places = F.sequence(F.lit(1), F.size("_marked") - ORDER)
    return marked.select(*keep, F.explode(F.transform(places, lambda k: F.array_join(F.slice("_marked", k, ORDER + 1), ""))).alias("gram"))


def gram_differences(urls: DataFrame) -> DataFrame:
    """(gram, millionths): for every gram of ``urls`` (url, label, held_out) the difference of its log
    probabilities under the models of accepted and of rejected URLs."""
    learned = {"a": "allow", "b": "block"}
    counts = stash(_grams(urls, "label", "held_out").groupBy("gram").agg(
        *[F.count_if((F.col("label") == verdict) & ~F.col("held_out")).alias(n) for n, verdict in learned.items()]), "url-grams")
    lower: DataFrame | None = None
    for k in range(ORDER + 1):
        here = counts.groupBy(F.right("gram", F.lit(k + 1)).alias("s")).agg(*[F.sum(n).alias(n) for n in learned])
        context = Window.partitionBy(F.left("s", F.lit(k)))  # as many rows as characters differ
        here = here.select("s", *learned, *[f(n).over(context).alias(x + n) for n in learned
                                            for f, x in ((F.sum, "all_"), (lambda n: F.sum((F.col(n) > 0).cast("long")), "kinds_"))])
        if lower is None:
            kinds = max(counts.select(F.right("gram", F.lit(1))).distinct().count(), 1)
            here = here.select("*", *[F.lit(1.0 / kinds).alias("low_" + n) for n in learned])
        else:
            here = here.join(lower, F.right("s", F.lit(k)) == F.col("shorter"))
        lower = here.select(F.col("s").alias("shorter"), *[
            F.when(F.col("all_" + n) > 0, (F.col(n) + F.col("kinds_" + n) * F.col("low_" + n)) / (F.col("all_" + n) + F.col("kinds_" + n)))
            .otherwise(F.col("low_" + n)).alias("low_" + n) for n in learned])
    return stash(lower.select(F.col("shorter").alias("gram"),
                              F.round((F.log("low_a") - F.log("low_b")) * MILLION).cast("long").alias("millionths")), "url-differences")


def calibrated_cut(scored: DataFrame) -> int:
    """The least score to accept, in millionths, from held-out rows (label, score)."""
    bins = scored.groupBy(F.floor(F.col("score") / F.lit(BIN)).alias("bin")).agg(
        F.count_if(F.col("label") == "allow").alias("a"), F.count_if(F.col("label") == "block").alias("b"))
    up, everything = Window.orderBy(F.desc("bin")), Window.partitionBy()  # over some thousand bins at most
    gain = F.sum("a").over(up) / F.sum("a").over(everything) - F.sum("b").over(up) / F.sum("b").over(everything)
    best = (bins.select("bin", F.lead("bin").over(up).alias("lower"), gain.alias("gain")).where("gain is not null")
            .orderBy(F.desc("gain"), F.abs("bin"), "bin").first())
    return 0 if best is None else (best["bin"] + (best["bin"] if best["lower"] is None else best["lower"] + 1)) * BIN // 2


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and score (nats a character) of each page.

    Null URLs and such without ``://`` have empty host and path, fit no rule and are judged by the
    models (null: as the empty text). Repeated rows are judged each, and alike; URLs of any length are
    judged whole; an empty table gives no rows; further columns are ignored. Without any labelled URL
    every score is 0 and every URL is accepted.
    """
    prepare(pages.sparkSession)
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", "url", *host_and_path(F.col("url")))
    urls = stash(urls.select("*", *decided(rules), F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 1).isin("0", "1", "2").alias("held_out"),
                             F.monotonically_increasing_id().alias("row")), "urls")
    grams = gram_differences(urls)
    scores = stash(_grams(urls, "row").join(grams, "gram").groupBy("row")
                   .agg(F.floor(F.sum("millionths") / F.count(F.lit(1))).cast("long").alias("score")), "url-scores")
    scored = urls.join(scores, "row")
    cut = calibrated_cut(scored.where("held_out and label is not null").select("label", "score"))
    verdict = F.coalesce("label", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), (F.col("score") / MILLION).alias("score"))
