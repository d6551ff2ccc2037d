"""Column rules shared by the jobs. Rule sets are parameters; the defaults are those of the mainland market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Exchanges by code prefix, their names, price limits, disclosure hosts,
# title rules, and currency units.
EXCHANGE_PREFIXES = {"SH": ["600", "601", "603", "605", "688", "689"], "SZ": ["000", "001", "002", "003", "300", "301"], "BJ": ["4", "8", "920"]}
WIDE_LIMIT_PREFIXES = ["300", "301", "688", "689"]
DISCLOSURE_HOSTS = ["cninfo.com.cn", "sse.com.cn", "szse.cn", "bse.cn"]
TITLE_RULES = [
    ("退市|立案|处罚|风险提示|重大诉讼", "监管与风险", "高"),
    ("年度报告|季度报告|半年报", "财务报告", "高"),
    ("业绩预告|业绩快报", "业绩动态", "高"),
    ("回购|分红|权益分派", "分红与回购", "中"),
    ("增持|减持|股权变动", "股权与资本", "中"),
    ("董事|监事|高管|治理", "公司治理", "中"),
    ("合同|项目|投资|并购", "经营动态", "中"),
]
TITLE_DEFAULT = ("其他公告", "低")
EVIDENCE_GROUPS = {"财务报告": "财务与业绩", "业绩动态": "财务与业绩", "经营动态": "经营事项", "分红与回购": "资本运作", "股权与资本": "资本运作", "公司治理": "治理与风险", "监管与风险": "治理与风险"}
EVIDENCE_GROUP_ORDER = ["财务与业绩", "经营事项", "资本运作", "治理与风险", "其他"]
CURRENCY_UNITS = {"元": 1, "千元": 1_000, "万元": 10_000, "百万元": 1_000_000, "亿元": 100_000_000}


def finite(value: Column) -> Column:
    """Null for NaN and the infinities."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def exchange(code: Column, prefixes: dict[str, list[str]] | None = None) -> Column:
    """Exchange of a six-digit code by its prefix; null for other codes and unknown prefixes."""
    found = F.lit(None).cast("string")
    for name, starts in (prefixes or EXCHANGE_PREFIXES).items():
        found = F.when(code.rlike(f"^(?:{'|'.join(starts)})"), name).otherwise(found)
    return F.when(code.rlike("^[0-9]{6}$"), found)


def price_limit(code: Column, name: Column, market_date: Column) -> Column:
    """Daily price-limit reference: 0.30, 0.20, 0.05 for risk warnings (0.10 in Shanghai from 2026-07-06), else 0.10."""
    warned = F.upper(F.regexp_replace(name, r"\s+", "")).rlike(r"^\*?ST")
    market = exchange(code)
    risk = F.when((market == "SH") & (market_date >= F.lit("2026-07-06").cast("date")), 0.10).otherwise(0.05)
    return F.when(market == "BJ", 0.30).when(code.rlike(f"^(?:{'|'.join(WIDE_LIMIT_PREFIXES)})"), 0.20).when(warned, risk).otherwise(0.10)


def allowed_url(url: Column, hosts: list[str] | None = None) -> Column:
    """Whether an http or https url points to an allowed host or a subdomain of one; null and bad urls do not."""
    host = F.lower(F.try_parse_url(F.trim(url), F.lit("HOST")))
    scheme = F.lower(F.try_parse_url(F.trim(url), F.lit("PROTOCOL")))
    suffix = "|".join(h.replace(".", r"\.") for h in hosts or DISCLOSURE_HOSTS)
    return F.coalesce(scheme.isin("http", "https") & host.rlike(rf"^(?:.+\.)?(?:{suffix})$"), F.lit(False))


def static_pdf_url(url: Column) -> Column:
    """The static PDF behind a detail link with an id of 8 to 20 digits and an ISO date; null if it has none."""
    query = lambda key: F.try_parse_url(F.trim(url), F.lit("QUERY"), F.lit(key))
    number, day = query("announcementId"), F.substring(query("announcementTime"), 1, 10)
    made = F.concat(F.lit("https://static.cninfo.com.cn/finalpage/"), day, F.lit("/"), number, F.lit(".PDF"))
    return F.when(allowed_url(url, ["cninfo.com.cn"]) & number.rlike("^[0-9]{8,20}$") & day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), made)


def classify(title: Column, rules: list[tuple[str, str, str]] | None = None, default: tuple[str, str] = TITLE_DEFAULT) -> tuple[Column, Column]:
    """Category and attention of a title: the first rule that matches, else the default."""
    category, attention = F.lit(default[0]), F.lit(default[1])
    for pattern, name, level in reversed(rules or TITLE_RULES):
        hit = F.coalesce(title.rlike(pattern), F.lit(False))
        category, attention = F.when(hit, name).otherwise(category), F.when(hit, level).otherwise(attention)
    return category, attention


def effective_turnover(turnover: Column, circulating: Column, free_float: Column) -> Column:
    """Turnover on the free float; null unless both share counts are positive, float <= circulating and turnover >= 0."""
    sound = (circulating > 0) & (free_float > 0) & (free_float <= circulating) & (turnover >= 0)
    return F.when(sound, turnover * circulating / free_float)


def unit_multiplier(unit: Column, units: dict[str, int] | None = None) -> Column:
    """Multiplier of a currency unit, with or without its currency; null for unknown units."""
    table = F.create_map(*(F.lit(x) for pair in (units or CURRENCY_UNITS).items() for x in pair))
    return F.try_element_at(table, F.regexp_replace(F.regexp_replace(unit, r"\s+", ""), "^(?:人民币|单位[:：])", ""))


def watchlist(text: Column) -> Column:
    """Tokens of a watchlist, split at white space, commas and semicolons of either width."""
    return F.filter(F.split(text, r"[\s,，;；、]+"), lambda t: t != "")


def keep_one(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an explicit order, not an arbitrary one."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("_place", place).where("_place = 1").drop("_place")
