"""URL verdicts: host and path rules first, a logistic regression on hashed character n-grams for the rest.

Defined results. A null URL or one without ``://`` has an empty host and path, fits no rule and is judged by the model on
its empty string like any other. Repeated rows are judged alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm.common import ascii_lower

#: Words of the labelled hosts; a host is a word with a modifier beside it. Fixed values, without names of any given table.
UNWANTED_WORDS = (
    "casino poker slots roulette jackpot bingo betting bets lotto pills viagra pharmacy steroids meds adult xxx porn cams escorts nude "
    "ads banner adserver popup tracker clicks loans payday forex replica spam backlinks linkbuilding warez torrents keygen cracked phishing scam prizes"
).split()
WANTED_WORDS = (
    "library museum school university journal news weather garden recipes cooking history science physics maths music opera cinema theatre "
    "travel hiking rivers forest birds health clinic hospital council parish archive letters poetry books reading film painting sports football "
    "chess linux python software database maps bicycle railway airport radio theory nation thread mother weather brother winter summer inland "
    "bibliothek schule zeitung wetter garten musik kirche verein lehre stadt ecole mairie jardin histoire lecture theatre cuisine sante biblioteca "
    "escuela historia noticias ciencia jardines tierra"
).split()
MODIFIERS = "best online top city day world club review daily north".split()
PATHS = ["/", "/en/12", "/archive/2019", "/articles/7.html", "/de/441", "/fr/9/", "/es/70", "/index.html", "/it/3", "/page/2"]
PREFIXES = ["", "www.", "m.", "blog."]
SUFFIXES = [".example.com", ".example.net", ".example.org", ".com", ".org"]


def labelled_urls() -> list[tuple[str, float]]:
    """The small labelled table: each word on three hosts; prefixes, suffixes, paths and modifiers take turns alike in both classes."""
    out = []
    for words, label in ((UNWANTED_WORDS, 1.0), (WANTED_WORDS, 0.0)):
        for i, word in enumerate(dict.fromkeys(words)):
            for k in range(3):
                modifier = MODIFIERS[(i + 3 * k) % len(MODIFIERS)]
                host = (word, f"{modifier}-{word}", f"{word}-{modifier}")[k]
                out.append((f"https://{PREFIXES[(i + k) % 4]}{host}{SUFFIXES[(i // 2 + k) % 5]}{PATHS[(i + 3 * k) % len(PATHS)]}", label))
    return out


def held_out(folds: int, fold: int) -> tuple[list[tuple[str, float]], list[tuple[str, float]]]:
    """Labelled URLs split by host word: to fit on, and to test on words that the others do not hold."""
    rows = labelled_urls()
    inside = [i // 3 % folds == fold for i in range(len(rows))]  # three URLs a word
    return [r for r, x in zip(rows, inside) if not x], [r for r, x in zip(rows, inside) if x]


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), else null. Rules are (verdict, host, path)."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda x: len(x[1]) + len(x[2])):  # the longest is asked first
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


#: Characters of a stretch; a place in a string is found by counting from its start, so n-grams are cut from short stretches.
STRETCH = 256


def char_ngrams(text: Column, sizes: tuple[int, ...]) -> Column:
    """All character n-grams as an array; texts shorter than n give none of that size."""
    stretches = F.transform(
        F.sequence(F.lit(0), F.floor(F.char_length(text) / STRETCH).cast("int")),
        lambda c: F.substring(text, c * STRETCH + 1, F.lit(STRETCH + max(sizes) - 1)),
    )

    def grams(stretch: Column, n: int) -> Column:
        last = F.least(F.char_length(stretch) - (n - 1), F.lit(STRETCH))
        each = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(stretch, i, F.lit(n)))
        return F.when(last >= 1, each).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(stretches, lambda x: reduce(lambda a, b: F.concat(a, b), [grams(x, n) for n in sizes])))


def _grams(df: DataFrame, host: Column, path: Column, sizes: tuple[int, ...]) -> DataFrame:
    marked = [F.concat(F.lit("^"), host, F.lit("$")), F.concat(F.lit("|"), path, F.lit("|"))]
    return df.withColumn("_grams", F.concat(*[char_ngrams(x, sizes) for x in marked]))


def fit(spark: SparkSession, labelled: list[tuple[str, float]] | None = None, sizes: tuple[int, ...] = (3, 4, 5), buckets: int = 1 << 14, reg: float = 0.01) -> PipelineModel:
    rows = spark.createDataFrame(labelled or labelled_urls(), "url string, label double").coalesce(1)
    grams = _grams(rows, host_of(F.col("url")), path_of(F.col("url")), sizes)
    stages = [
        HashingTF(inputCol="_grams", outputCol="_features", numFeatures=buckets, binary=True),
        LogisticRegression(featuresCol="_features", labelCol="label", regParam=reg, maxIter=60, probabilityCol="_probability", predictionCol="_prediction", rawPredictionCol="_raw"),
    ]
    return Pipeline(stages=stages).fit(grams)


def judge(
    pages: DataFrame, model: PipelineModel, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
    sizes: tuple[int, ...] = (3, 4, 5), threshold: float = 0.5,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score (the model's probability of being unwanted)."""
    url = F.col(url_col)
    parts = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    scored = model.transform(_grams(parts, F.col("host"), F.col("path"), sizes))
    score = vector_to_array("_probability")[1]
    hit = matched_rule(F.col("host"), F.col("path"), rules)
    own = F.when(score > threshold, "block").otherwise("allow")
    return scored.select(
        id_col, "host", "path", hit["rule"].alias("rule"), F.coalesce(hit["verdict"], own).alias("verdict"), score.alias("score"),
    )
