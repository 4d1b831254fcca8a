"""URL filters: host and path rules, and logistic regression on hashed character n-grams for the rest.

The model is fitted by ``pyspark.ml`` on a small labelled table of URLs and becomes a literal array of
weights, so judging is one projection of built-in functions. The rule table (bounded by ``MAX_RULES``)
is compiled into one CASE, longest rule first.

The table is general knowledge: words of wanted and unwanted sites, in shapes of host and path that both have
and in shapes typical of either.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and is judged by
the model like any other; rows are judged one by one, so repeated rows and null ids pass through, and a url of any
length is judged whole; of rules of equal length that fit, the first by name wins; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lower_ascii

#: verdict, rule: host, then the start of the path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MAX_RULES = 1000
N_GRAMS, BUCKETS, CUTOFF = (3, 4), 4096, 0.5
#: The ridge penalty against the whole log loss, so that it does not depend on the number of labelled URLs; 0.05 at 60 of them.
PENALTY = 3.0
#: General vocabulary of unwanted sites (gambling, medicines, pornography, fraud, malware, unlicensed copies).
BAD_WORDS = """casino poker roulette slots jackpot betting gambling lottery bingo viagra cialis pills pharmacy steroids
slimming diet porn xxx sex nude escort hookup camgirls milf fetish payday loan credit forex bitcoin giveaway winner prize
voucher freebie discount replica rolex counterfeit crack keygen warez torrent serial hack cheats malware trojan phishing
spam clickbait popup adserver scam mlm ponzi unlimited miracle""".split()
#: General vocabulary of wanted sites.
GOOD_WORDS = """university school library museum hospital clinic parliament ministry council court police embassy news weather
science physics chemistry biology history geography language dictionary encyclopedia archive journal research institute
theatre orchestra gallery cinema festival football athletics cycling chess railway airport harbour bus hotel restaurant
bakery garden kitchen recipe travel map city village church architecture engineering software linux python database
hardware electronics support manual forum community charity insurance bank post family teacher student children health""".split()
#: Shapes of either kind of site, and those that are typical of unwanted and of wanted ones.
SHARED_SHAPES = ("www.{a}.com/", "{a}{b}.net/{c}/12", "{a}-{b}.com/en/index.html")
BAD_SHAPES = (
    "{a}-{b}-{c}.top/", "best-{a}-online.xyz/?aff=12", "{a}24.click/go/{b}", "{a}-{b}.win/signup?bonus=100", "x{a}777.info/promo/{b}.php?id=9", "free-{a}-{b}.biz/download.exe", "get{a}now.site/offer?ref=88", "{a}.{b}-{c}.club/redirect?u=1",
)
GOOD_SHAPES = (
    "www.{a}.org/{b}/", "{a}.edu/{b}/{c}.html", "www.{a}-{b}.gov/news/2019/05/{c}", "docs.{a}.org/en/{b}.html", "{b}.{a}.ac.uk/about", "blog.{a}.com/2021/03/{b}-{c}", "en.{a}.org/articles/{b}", "www.{a}.de/{b}/345.html",
    "m.{a}.net/de/25", "{a}.com/{b}/{c}", "blog.{a}{b}.net/", "www.{b}{a}.com/fr/7.html", "{a}.net/{b}/", "shop.{a}-{b}.com/es/list",
)


def urls_of(words: list[str], shapes: tuple[str, ...]) -> list[str]:
    """URLs without scheme: every word in every shape, each time beside other words of the list."""
    n = len(words)
    return [shape.format(a=w, b=words[(i + 5 * k + 7) % n], c=words[(i + 11 * k + 17) % n]) for i, w in enumerate(words) for k, shape in enumerate(shapes)]


BAD, GOOD = urls_of(BAD_WORDS, SHARED_SHAPES + BAD_SHAPES), urls_of(GOOD_WORDS, SHARED_SHAPES + GOOD_SHAPES)


def parts(pages: DataFrame) -> DataFrame:
    """Adds host (lower-case) and path to ``pages`` (url)."""
    after = F.expr("if(coalesce(instr(url, '://'), 0) = 0, '', substr(url, instr(url, '://') + 3))")
    out = pages.withColumn("_after", after)
    out = out.withColumn("_host", F.regexp_extract("_after", r"^[^/?#]*", 0))
    rest = F.expr("substr(_after, char_length(_host) + 1)")
    return out.withColumns({"host": lower_ascii(F.col("_host")), "path": F.regexp_extract(rest, r"^[^?#]*", 0)}).drop("_after", "_host")


def _terms(sizes: tuple[int, ...], buckets: int) -> str:
    """SQL for the distinct hashed n-grams of host and path."""
    line = "concat('^', host, ' ', path, '$')"
    grams = [f"transform(sequence(1, greatest(1, char_length(u) - {n - 1})), i -> cast(pmod(xxhash64(substr(u, i, {n})), {buckets}) as int))" for n in sizes]
    return f"element_at(transform(array({line}), u -> array_distinct(concat({', '.join(grams)}))), 1)"


def fit(spark: SparkSession, bad: list[str] = BAD, good: list[str] = GOOD, buckets: int = BUCKETS) -> tuple[float, list[float]]:
    """(intercept, a weight per bucket) from two lists of URLs without scheme."""
    lists = " UNION ALL ".join(f"SELECT {y}D AS label, explode(split('{' '.join(us)}', ' ')) AS u" for us, y in ((bad, 1), (good, 0)))
    labelled = parts(spark.sql(f"SELECT label, concat('http://', u) AS url FROM ({lists})")).withColumn("terms", F.expr(_terms(N_GRAMS, buckets)))
    counted = CountVectorizerModel.from_vocabulary([str(i) for i in range(buckets)], "names", "features").transform(labelled.withColumn("names", F.col("terms").cast("array<string>")))
    model = LogisticRegression(regParam=PENALTY / len([*bad, *good]), maxIter=60, standardization=False).fit(counted.select("label", "features").coalesce(1))
    return float(model.intercept), [round(float(w), 6) for w in model.coefficients.toArray()]


def _rule(rules: tuple[tuple[str, str], ...]) -> tuple[str, str]:
    """SQL for (rule, verdict) of the longest rule that fits, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules are compiled")
    whens = {"rule": "", "verdict": ""}
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, _, path = rule.partition("/")
        host, path, name = (x.replace("\\", "\\\\").replace("'", "\\'") for x in (host, "/" + path, rule))
        fits = f"(host = '{host}' or endswith(host, '.{host}')) and startswith(path, '{path}')"
        whens["rule"] += f" when {fits} then '{name}'"
        whens["verdict"] += f" when {fits} then '{verdict}'"
    return (f"case{whens['rule']} end", f"case{whens['verdict']} end") if rules else ("cast(null as string)", "cast(null as string)")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, cutoff: float = CUTOFF) -> DataFrame:
    """page_id, host, path, rule, verdict, spam_score for every row of ``pages`` (page_id, url)."""
    bias, weights = fit(pages.sparkSession)
    table = "cast(split('" + " ".join(map(repr, weights)) + "', ' ') as array<double>)"  # folded into one literal
    score = f"aggregate({_terms(N_GRAMS, BUCKETS)}, {bias!r}D, (s, b) -> s + get({table}, b))"
    rule, verdict = _rule(rules)
    split = parts(pages.select("page_id", "url"))
    scored = split.select("page_id", "host", "path", F.expr(rule).alias("rule"), F.expr(verdict).alias("_verdict"), F.expr(f"1 / (1 + exp(-({score})))").alias("spam_score"))
    model = F.when(F.col("spam_score") >= cutoff, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_verdict", model).alias("verdict"), "spam_score")
