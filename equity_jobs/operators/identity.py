"""Company identity and lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equity_jobs.functions.rules import exchange, keep_one


def company_identity(directory: DataFrame, order: list[Column]) -> DataFrame:
    """CL7: the first named row of each six-digit code of a known exchange, with its canonical code."""
    code = F.regexp_extract(F.col("code").cast("string"), "([0-9]{6})", 1)
    rows = directory.withColumns({"code": code, "name": F.trim("name")}).where("code <> '' and name <> ''")
    rows = keep_one(rows, ["code"], order).withColumn("exchange", exchange(F.col("code"))).where("exchange is not null")
    return rows.withColumn("canonical_code", F.concat_ws(".", "code", "exchange"))


def watchlist_codes(lists: DataFrame, owner: str, text: str, tokens: Column, top: int = 5) -> DataFrame:
    """CL10: of each owner the first top codes in order, duplicates and codes over the cap counted, and the tokens that are no code, in order, listed and counted."""
    rows = lists.select(owner, F.posexplode(tokens).alias("place", "token")).withColumn("sound", F.col("token").rlike("^[0-9]{6}$"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy(owner, "token").orderBy("place")))
    codes = first.withColumn("order", F.sum((F.col("sound") & (F.col("n") == 1)).cast("int")).over(Window.partitionBy(owner).orderBy("place")))
    taken = F.col("sound") & (F.col("n") == 1)
    in_order = lambda test: F.sort_array(F.collect_list(F.when(test, F.struct("place", "token"))))["token"]
    return codes.groupBy(owner).agg(
        in_order(taken & (F.col("order") <= top)).alias("codes"), F.count_if(F.col("sound") & (F.col("n") > 1)).alias("duplicates"), F.count_if(~F.col("sound")).alias("invalid"),
        in_order(~F.col("sound")).alias("invalid_tokens"), F.count_if(taken & (F.col("order") > top)).alias("over_cap"),
    )


def resolve(queries: DataFrame, directory: DataFrame, top: int = 8) -> DataFrame:
    """Companies of a query text by code, exact name, or part of the name; an exact hit hides the partial ones.

    queries: query_id, text. directory: code, name, broadcast as a dimension of the market's companies.
    """
    plain = lambda c: F.regexp_replace(F.upper(c), r"\s+", "")
    asked = queries.withColumns({"_text": plain(F.col("text")), "_code": F.regexp_extract("text", r"(?i)(?:^|[^0-9A-Z])(?:SH|SZ|BJ)?([0-9]{6})(?:\.(?:SH|SZ|BJ))?(?:$|[^0-9])", 1)})
    known = directory.select("code", "name", plain(F.col("name")).alias("_name"))
    by_code = asked.where("_code <> ''").join(known, F.col("_code") == F.col("code")).withColumn("tier", F.lit(1))
    rest = asked.where("_code = '' and _text <> ''")
    exact = rest.join(known, F.col("_text") == F.col("_name")).withColumn("tier", F.lit(2))
    # names hold only short texts: match by the text's own length of every name's substrings, an equi-join
    parts = known.select("code", "name", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.char_length("_name")), lambda i: F.transform(F.sequence(F.lit(2), F.greatest(F.char_length("_name") - i + 1, F.lit(2))), lambda n: F.substring("_name", i, n)))))).alias("_part"))
    partial = rest.join(parts, F.col("_text") == F.col("_part")).withColumn("tier", F.lit(3))
    columns = ["query_id", "text", "code", "name", "tier"]
    hits = by_code.select(columns).unionByName(exact.select(columns)).unionByName(partial.select(columns))
    best = F.dense_rank().over(Window.partitionBy("query_id").orderBy("tier"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("code"))
    return hits.withColumn("_best", best).where("_best = 1").drop("_best").dropDuplicates(["query_id", "code"]).withColumn("place", place).where(F.col("place") <= top)
