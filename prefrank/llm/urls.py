"""URL filters: rules by host and path first, then a model on character n-grams.

The model is a logistic regression on hashed n-grams of host and path, fitted on a small labelled URL
table. Rules are a short list, so they become one expression; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prefrank.llm.common import ascii_lower

#: Fixed values of the default labelled table: words in host names of sites to block and of ordinary sites, words
#: that go with either, and forms of hosts and paths. Every word meets some of the other lists by its number.
BLOCKED_WORDS = ["casino", "poker", "slots", "roulette", "blackjack", "jackpot", "baccarat", "bingo", "lottery", "lotto", "gambling", "gamble", "betting", "bets", "sportsbet", "wager", "bookmaker",
                 "viagra", "cialis", "levitra", "pills", "steroids", "painkillers", "xanax", "tramadol", "payday", "loans", "fastcash", "forex", "binaryoptions", "ponzi", "getrich",
                 "porn", "porno", "pornstar", "xxx", "sex", "sexcam", "adult", "escort", "hentai", "nude", "milf", "fetish", "hookup", "camgirls",
                 "warez", "keygen", "cracked", "serials", "torrent", "malware", "phishing", "spyware", "ransom", "trojan", "botnet", "exploit",
                 "spam", "linkfarm", "backlinks", "doorway", "clickbait", "popads", "adserver", "ads", "adclick", "tracker", "tracking", "banners", "replica", "counterfeit", "fakeid"]
ORDINARY_WORDS = ["news", "weather", "library", "garden", "recipes", "history", "science", "school", "museum", "music", "travel", "sports", "health", "city", "university", "books", "forum", "archive", "research", "photos",
                  "theatre", "market", "bakery", "physics", "railway", "gazette", "times", "herald", "mother", "father", "brother", "thirty", "north", "south", "southern", "earth", "weaver", "leather", "feather", "gathering",
                  "lighthouse", "river", "village", "kitchen", "cottage", "harbour", "mountain", "botany", "chemistry", "poetry", "novels", "letters", "painting", "pottery", "cinema", "radio", "station", "nation", "motion", "tradition",
                  "exhibition", "institute", "society", "parish", "council", "charity", "hospital", "clinic", "dentist", "insurance", "bank", "taxes", "post", "courier", "ferry", "airport", "hotel", "hostel", "camping", "hiking",
                  "software", "engineering", "robotics", "hardware", "database", "mathematics", "algebra", "geometry", "astronomy", "biology", "geology", "medicine", "pharmacology", "nursing", "therapy", "statistics", "economics", "finance", "credit", "lawyers",
                  "justice", "parliament", "election", "embassy", "passport", "customs", "counties", "villages", "address", "headset", "signal", "athletics", "roads", "uploads", "threads", "letterbox", "carpentry", "alphabet", "racing",
                  "government", "language", "animals", "ocean", "forest", "winter", "summer", "bridge", "castle", "family", "children", "teacher", "student", "office", "garage", "bicycle", "tennis", "football", "swimming", "dancing",
                  "singing", "cooking", "coffee", "orchard", "flowers", "horses", "sailing", "climbing", "furniture", "knitting", "jewellery", "clothing", "shoes", "printing", "maps", "trains", "planets", "fossils", "mushrooms", "vegetables"]
SHARED_WORDS = ["best", "online", "king", "mega", "club", "zone", "hub", "world", "direct", "royal", "city", "star", "central", "today", "plus", "land", "house", "point", "first", "shop", "info", "place", "net", "team", "group", "global"]
NAME_FORMS = ["{0}", "{1}{0}", "{0}-{1}", "{0}{1}", "{1}-{0}", "the{0}{1}", "{0}{1}24"]
HOST_FORMS = ["{}.com", "www.{}.org", "{}.net", "blog.{}.info", "www.{}.com", "{}.co.uk", "shop.{}.biz", "m.{}.io", "{}.example.com", "www.{}.example.org", "blog.{}.example.net"]
PATH_FORMS = ["/", "", "/index.html", "/articles/{0}", "/about", "/2024/05/{0}.html", "/en/{0}", "/item?id={0}", "/category/{0}/", "/de/page/{0}", "/search?q={0}", "/fr/{0}#top", "/es/{0}/"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or end, A-Z lower-cased; path: then up to ?, # or end.

    Both are empty if the url is null or has no ://.
    """
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(F.split(rest, "[?#]", 2)[0], F.lit(""))
    host = F.split(rest, "/", 2)[0]
    return ascii_lower(host), F.substring(rest, F.length(host) + 1, F.length(rest))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default labelled table: url, label (1: block) and name (of the site), about 5,000 rows.

    Each word of the lists gives a name in every form, on three hosts and paths, which say nothing about the label.
    """
    rows = []
    for label, words in ((1.0, BLOCKED_WORDS), (0.0, ORDINARY_WORDS)):
        for i, word in enumerate(words):
            for j, form in enumerate(NAME_FORMS):
                name = form.format(word, SHARED_WORDS[(5 * i + 7 * j) % len(SHARED_WORDS)])
                for n in (3 * i + 5 * j, 7 * i + j + 4, i + 9 * j + 8):
                    rows.append(("https://" + HOST_FORMS[n % len(HOST_FORMS)].format(name) + PATH_FORMS[(n + i) % len(PATH_FORMS)].format(n), label, name))
    return spark.createDataFrame(rows, "url string, label double, name string").coalesce(1)


def grams_of(edged: Column, mark: str, n: int) -> Column:
    """All pieces of n characters; the whole text if it is shorter."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(edged) - n + 1, F.lit(1))), lambda at: F.concat(F.lit(mark), F.substring(edged, at, F.lit(n))))


def ngrams(text: Column, mark: str, sizes: tuple[int, ...]) -> Column:
    """Character n-grams of a text between edges, each with the mark of its part of the url."""
    edged = F.concat(F.lit("^"), text, F.lit("$"))
    return F.concat(*[grams_of(edged, mark, n) for n in sizes])


def with_grams(df: DataFrame, url: str, sizes: tuple[int, ...]) -> DataFrame:
    host, path = host_and_path(F.col(url))
    return df.withColumn("host", host).withColumn("path", path).withColumn("__grams", F.concat(ngrams(F.col("host"), "h", sizes), ngrams(F.col("path"), "p", sizes)))


def fitted(rows: DataFrame, buckets: int, ridge: float) -> PipelineModel:
    stages = [HashingTF(inputCol="__grams", outputCol="__features", numFeatures=buckets, binary=True),
              LogisticRegression(featuresCol="__features", labelCol="label", regParam=ridge, maxIter=50, rawPredictionCol="__raw", probabilityCol="__probability", predictionCol="__block")]
    return Pipeline(stages=stages).fit(rows)


def held_out_scores(rows: DataFrame, buckets: int, ridge: float, folds: int) -> list[tuple[float, float]]:
    """(label, probability to block) of each row of the labelled table, by a model that saw no row of its name."""
    d = rows.withColumn("__fold", F.crc32(F.col("name").cast("binary")) % folds)
    out = []
    for f in range(folds):
        train_rows, held = d.where(F.col("__fold") != f), d.where(F.col("__fold") == f)
        if {r[0] for r in train_rows.select("label").distinct().collect()} == {0.0, 1.0}:
            scored = fitted(train_rows, buckets, ridge).transform(held).select("label", vector_to_array("__probability")[1])
            out += [tuple(r) for r in scored.collect()]
    return out


def train(labelled: DataFrame, sizes: tuple[int, ...] = (3, 4, 5), buckets: int = 1 << 16, ridge: float = 0.01, threshold: float | None = None, folds: int = 3, false_blocks: float = 0.002) -> PipelineModel:
    """Fit on url, label (1: block, 0: allow), name (of the site); rows with a null url or label are left out.

    A probability of `threshold` or more blocks. Without one, it is the least, in steps of 0.01 from 0.5, at which
    models that did not see a name block at most the share `false_blocks` of the urls to allow; 0.9 if there is
    none below it, 0.5 if names are too few to hold any out. The table is small by contract; repeated rows weigh
    more; without a column `name` the url takes its place.
    """
    named = labelled if "name" in labelled.columns else labelled.withColumn("name", F.col("url"))
    rows = with_grams(named.dropna(subset=["url", "label"]).withColumn("name", F.coalesce("name", "url")), "url", sizes).cache()
    try:
        if threshold is None:
            scores = held_out_scores(rows, buckets, ridge, folds)
            allowed = [p for label, p in scores if label == 0]
            steps = [n / 100 for n in range(50, 90)]
            threshold = next((t for t in steps if sum(p >= t for p in allowed) <= false_blocks * len(allowed)), 0.9)
        model = fitted(rows, buckets, ridge)
    finally:
        rows.unpersist()
    model.stages[-1].setThreshold(threshold)
    return model


def rule_verdict(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none. A rule is (verdict, host/path)."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, start = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + start))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def judge(df: DataFrame, rules: list[tuple[str, str]], model: PipelineModel, url: str = "url", sizes: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """Add host, path, rule and verdict ('allow' or 'block'): the rule's, or else the model's.

    A null or malformed url has an empty host and path, fits no rule and gets the model's verdict on empty
    strings. Columns of `df` with the new names are replaced, other columns and all rows stay, repeated ones
    too. Urls of any length are judged whole. An empty table gives no rows.
    """
    new = {"host", "path", "rule", "verdict"}
    source = df.select(*[F.col(f"`{c}`").alias(c) for c in df.columns if c.lower() not in new or c == url])
    scored = model.transform(with_grams(source, url, sizes))
    rule, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("__block") == 1, "block").otherwise("allow")
    return scored.select(*source.columns, "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"))
