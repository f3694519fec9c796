"""URL filter: allow and block rules, else logistic regression on hashed character n-grams of host and path.

DataFrame functions and Spark ML only.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with its path; the longest wins.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
#: The small labelled table is made of these words of site names, that are blocked or allowed, alone and joined with others.
#: It is only the default of a parameter: ``judge`` and ``train`` take any table of urls and labels.
BLOCKED_NAMES = tuple(
    "casino poker roulette blackjack jackpot slots betting bets gambling lottery bingo wager sportsbook "
    "adult porn xxx sex escort nude erotic camgirls hookup fetish webcam hentai "
    "pills viagra cialis steroids pharmacy painkiller diet slimming miracle botox "
    "replica rolex knockoff counterfeit cheap discount handbags "
    "spam malware phishing virus keygen warez torrents crack hacked botnet exploit cheats "
    "ads adserver tracker popup clickbait banner affiliate "
    "payday loans forex crypto bitcoin getrich moneyfast freecash giveaway prize winner".split()
)
ALLOWED_NAMES = tuple(
    "news library university weather garden recipes science history museum docs travel health sports music photo teacher math "
    "bookshop house forum wiki archive maps engineer shirt thunder station nation theatre kitchen hospital school college city "
    "county village council government parliament court police fire rescue church temple charity volunteer museums gallery art "
    "design architect builder carpenter plumber electric energy solar water forest river mountain ocean island beach hotel "
    "restaurant bakery coffee tea wine farm market grocery fashion shoes jewelry watch clock camera computer software code "
    "developer data research journal paper magazine radio television film cinema opera dance concert festival sport football "
    "tennis cycling running yoga fitness clinic dental doctor nurse pediatric family baby kids toys puzzle chess pet dog cat horse "
    "bird zoo animal nature climate earth space astronomy physics chemistry biology medicine law finance bank insurance tax "
    "career job training course language translate dictionary poetry novel story blog diary calendar event wedding party".split()
)
#: How a name stands in a host; {} is the word.
COMPOUNDS = ("{}", "my{}", "best-{}", "{}-zone", "{}24", "the{}land")
#: Forms of the table's urls; {} is the name. Both labels share them, so that only names tell the labels apart.
FORMS = (
    "https://{}.example.com/", "https://www.{}.example.net/en/12.html", "http://blog.{}.example.org/de/340",
    "https://m.{}.net/fr/99/", "http://{}.com/es/7081/", "https://{}.org/{}", "https://www.example.org/{}/1.html",
)
BUCKETS = 1 << 14


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?``, ``#`` or the end. Both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; both null if none does."""
    names, verdicts = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        names, verdicts = F.when(fits, h + p).otherwise(names), F.when(fits, verdict).otherwise(verdicts)
    return names, verdicts


def grams(host: Column, path: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Character n-grams of host and path with their ends marked, told apart by a prefix."""
    def of(text: Column, mark: str) -> list[Column]:
        t = F.concat(F.lit("^"), F.lower(text), F.lit("$"))
        return [
            F.transform(F.when(F.length(t) >= n, F.sequence(F.lit(1), F.length(t) - (n - 1))).otherwise(F.array().cast("array<int>")), lambda i, n=n: F.concat(F.lit(mark), F.substring(t, i, n)))
            for n in sizes
        ]

    return F.concat(*of(host, "h:"), *of(path, "p:"))


def neutral(n: int = 400) -> list[str]:
    """Names without a meaning, of two to four syllables by a fixed rule: most sites' names say nothing."""
    syllables = [a + b for a in "bdfgklmnprstv" for b in ("a", "e", "i", "o", "u", "an", "er", "in", "ol")]
    return ["".join(syllables[(k * 37 + j * j * 53 + k * j * 11) % len(syllables)] for j in range(2 + k % 3)) for k in range(n)]


def labelled(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, label): every word in every compound and form, names without a meaning as allowed
    ones; label 1 is block."""
    made = [
        (form.replace("{}", compound.replace("{}", word)), label)
        for words, label in ((BLOCKED_NAMES, 1.0), (ALLOWED_NAMES, 0.0)) for word in words for compound in COMPOUNDS for form in FORMS
    ]
    made += [(form.replace("{}", name), 0.0) for name in neutral() for form in FORMS]
    return spark.createDataFrame(made, "url string, label double")


def features(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with host, path and grams."""
    host, path = parts(F.col(url_col))
    return urls.withColumn("host", host).withColumn("path", path).withColumn("grams", grams(F.col("host"), F.col("path")))


def train(table: DataFrame, buckets: int = BUCKETS, l2: float = 1e-6) -> PipelineModel:
    """Hashed n-gram presence, weighed by rarity and of length 1, and a logistic regression, from a labelled table (url, label)."""
    steps = [
        HashingTF(inputCol="grams", outputCol="hashed", numFeatures=buckets, binary=True), IDF(inputCol="hashed", outputCol="weighed"),
        Normalizer(inputCol="weighed", outputCol="scaled"),
        LogisticRegression(featuresCol="scaled", labelCol="label", regParam=l2, maxIter=40, standardization=False),
    ]
    return Pipeline(stages=steps).fit(features(table).select("grams", "label"))


def judge(
    pages: DataFrame, model: PipelineModel | None = None, table: DataFrame | None = None, rules: tuple = RULES, block_from: float = 0.5,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """Per row: page_id, host, path, rule (host and path of the one that decides, else null), verdict and block_score.

    The classifier is ``model``, else trained from ``table`` (url, label; 1 is block), by default ``labelled``. ``verdict`` is
    the rule's, else ``block`` where the classifier's block_score is at least ``block_from``. A null url
    or one without ``://`` has an empty host and path and is judged by the classifier; repeated rows are judged each; an
    empty table gives no rows.
    """
    model = model or train(table if table is not None else labelled(pages.sparkSession))
    scored = model.transform(features(pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"))))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    score = F.round(vector_to_array("probability")[1], 6)
    own = F.when(score >= block_from, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), score.alias("block_score"))
