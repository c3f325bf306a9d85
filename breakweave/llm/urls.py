"""URL filter: longest-match rules, then the likelihood ratio of two character language models.

The models are smoothed variable-order Markov models of the urls that rules allow and of those that rules block. A url is
its host and path, folded to a small alphabet. A context is the last 0 to ORDERS - 1 characters, hashed into SLOTS cells;
an order's probability is its counts smoothed with the next shorter order's probability, so unseen contexts fall back.
The score is the log-likelihood difference divided by the number of predicted characters. It is calibrated on the ruled
urls themselves, each scored without its own counts: the threshold is the score cell with the least balanced error.

Everything on this path is DataFrame functions. The model has at most ORDERS * SLOTS * (alphabet + 1) rows whatever the
input, which is the proven bound of what is broadcast.

Defined results: a null url or one without `://` has empty host and path and matches no rule; its verdict is that of the
empty text (only the end is predicted). With no ruled url of either kind the scores are 0 and every url is allowed. Null
ids are carried; repeated rows are judged alike; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breakweave.llm.common import stage

#: What a character can be; any other counts as the last one.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._~/%?"
ORDERS = 5
SLOTS = 4093
#: Weight of the shorter order's probability.
SMOOTHING = 2.0
#: Width of a calibration cell, in nats a character.
CELL = 0.02


def host_of(url: Column) -> Column:
    after = F.expr("substring(url, locate('://', url) + 3)")
    return F.when(url.contains("://"), F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    after = F.expr("substring(url, locate('://', url) + 3)")
    return F.when(url.contains("://"), F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(the rule that fits, its verdict), longest first; rules are (action, host/path). Null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, pattern in reversed(ordered):
        rule_host, slash, rest = pattern.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, pattern).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def characters(judged: DataFrame, orders: int = ORDERS) -> DataFrame:
    """A row for each character that a url's text predicts, its end included: `sym` and a context cell for each order."""
    start = "^" * (orders - 1)
    text = F.concat(F.lit(start), F.lower(F.concat("host", "path")), F.lit("$"))
    known = ALPHABET[:-1]
    folded = F.regexp_replace(text, "[^" + known.replace("-", "") + r"\-^$]", ALPHABET[-1])
    rows = judged.withColumn("folded", folded).withColumn("at", F.explode(F.sequence(F.lit(orders), F.length("folded"))))
    code = f"locate(substring(folded, at - {{}}, 1), '{ALPHABET}^$')"
    rows = rows.withColumn("sym", F.expr(code.format(0)))
    cell = F.lit(0).cast("long")
    size = len(ALPHABET) + 3
    for k in range(orders):
        if k:
            cell = cell + F.expr(code.format(k)) * F.lit(size ** (k - 1))
        rows = rows.withColumn(f"cell{k}", F.pmod(cell, F.lit(SLOTS)).cast("int"))
    return rows.drop("folded", "at")


def train(chars: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(k, cell, sym, ok, bad, ok_all, bad_all): what follows each context cell among allowed and blocked urls."""
    each = chars.select("sym", "verdict", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"cell{k}").alias("cell")) for k in range(orders)])).alias("c"))
    counts = each.groupBy("c.k", "c.cell", "sym").agg(F.count_if(F.col("verdict") == "allow").alias("ok"), F.count_if(F.col("verdict") == "block").alias("bad"))
    context = Window.partitionBy("k", "cell")
    return counts.withColumn("ok_all", F.sum("ok").over(context)).withColumn("bad_all", F.sum("bad").over(context))


def scores(chars: DataFrame, model: DataFrame, keys: list[str], own: bool, orders: int = ORDERS) -> DataFrame:
    """(keys, score, length). own: leave out one occurrence of what the url itself has counted."""
    rows = chars
    for k in range(orders):
        part = model.where(F.col("k") == k).select(
            F.col("cell").alias(f"cell{k}"), "sym", F.col("ok").alias(f"ok{k}"), F.col("bad").alias(f"bad{k}")
        )
        whole = model.where(F.col("k") == k).groupBy(F.col("cell").alias(f"cell{k}")).agg(F.max("ok_all").alias(f"ok_all{k}"), F.max("bad_all").alias(f"bad_all{k}"))
        rows = rows.join(F.broadcast(part), [f"cell{k}", "sym"], "left").join(F.broadcast(whole), f"cell{k}", "left")
    logs = []
    for kind, verdict in (("ok", "allow"), ("bad", "block")):
        minus = F.when(F.col("verdict") == verdict, 1).otherwise(0) if own else F.lit(0)
        p = F.lit(1.0 / (len(ALPHABET) + 1))
        for k in range(orders):
            n = F.greatest(F.coalesce(F.col(f"{kind}{k}"), F.lit(0)) - minus, F.lit(0))
            total = F.greatest(F.coalesce(F.col(f"{kind}_all{k}"), F.lit(0)) - minus, n)
            p = (n + SMOOTHING * p) / (total + SMOOTHING)
        logs.append(F.log(p))
    return rows.groupBy(*keys).agg((F.sum(logs[0] - logs[1]) / F.count("*")).alias("score"), F.count("*").alias("length"))


def threshold(scored: DataFrame) -> float:
    """Least score that is allowed: the cell edge with the least balanced error on the ruled urls; ties: nearest 0, then lower."""
    cells = scored.groupBy(F.floor(F.col("score") / CELL).alias("cell")).agg(F.count_if(F.col("verdict") == "allow").alias("ok"), F.count_if(F.col("verdict") == "block").alias("bad"))
    up = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # scores lie within the logs of the smoothed probabilities, so there are at most a few thousand cells
    edges = cells.select(
        "cell",
        F.coalesce(F.sum("ok").over(up), F.lit(0)).alias("lost"),
        F.coalesce(F.sum("bad").over(up), F.lit(0)).alias("caught"),
        F.sum("ok").over(Window.partitionBy()).alias("all_ok"),
        F.sum("bad").over(Window.partitionBy()).alias("all_bad"),
    )
    error = F.col("lost") / F.greatest("all_ok", F.lit(1)) + 1 - F.col("caught") / F.greatest("all_bad", F.lit(1))
    best = edges.withColumn("error", error).orderBy("error", F.abs("cell"), "cell").limit(1).collect()
    return float(best[0]["cell"]) * CELL if best and best[0]["all_ok"] and best[0]["all_bad"] else -1e9


def judge(df: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row for each row of df: page_id, host, path, rule, verdict, score (of the models, whatever the rule says)."""
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    url = F.coalesce(F.col("url"), F.lit(""))
    pages = pages.withColumn("url", url).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    pages = pages.withColumn("rule", rule).withColumn("ruled", ruled)
    labelled = pages.where("ruled is not null").select("host", "path", F.col("ruled").alias("verdict")).distinct()
    model = stage(train(characters(labelled)))
    limit = threshold(scores(characters(labelled), model, ["host", "path", "verdict"], own=True))
    texts = pages.select("host", "path").distinct().withColumn("verdict", F.lit(None).cast("string"))
    judged = scores(characters(texts), model, ["host", "path"], own=False).select("host", "path", "score")
    return pages.join(judged, ["host", "path"]).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= limit, "allow").otherwise("block")).alias("verdict"), "score"
    )
