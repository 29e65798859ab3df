"""Company profile rules."""

from pyspark.sql import DataFrame, functions as F

# Industries counted as mainstream, and risks per industry.
MAINSTREAM_INDUSTRIES = ["银行", "保险", "证券"]
INDUSTRY_RISKS = {
    "房地产": ["政策调控风险", "周期性风险"],
    "银行": ["信用风险", "利率风险"],
    "白酒": ["消费降级风险"],
    "家电": ["原材料价格风险", "竞争加剧风险"],
}


def company_profile(company: DataFrame, industry_sectors: dict | None = None) -> DataFrame:
    """+position, risks, potential, drivers from industry and concepts; sector filled by industry."""
    concepts = F.coalesce("concepts", F.array().cast("array<string>"))
    joined = F.concat_ws(",", concepts)
    industry = F.col("industry")
    has = lambda term: F.array_contains(concepts, term)
    position = (
        F.when(joined.contains("龙头") | joined.contains("领涨"), "龙头")
        .when(joined.contains("头部"), "头部")
        .when(industry.isin(*MAINSTREAM_INDUSTRIES), "主流")
        .otherwise("一般")
    )
    risks = F.array(F.lit("市场波动风险"))
    for name, items in INDUSTRY_RISKS.items():
        risks = F.when(industry == name, F.array(*[F.lit(i) for i in items])).otherwise(risks)
    drivers = F.array_compact(
        F.array(
            F.when(has("消费升级"), "消费升级趋势"),
            F.when(has("金融科技"), "数字化转型"),
            F.when(has("新能源") | joined.contains("智能"), "技术创新"),
        )
    )
    sector = F.col("sector")
    for key, name in reversed(list((industry_sectors or {}).items())):
        sector = F.when((F.coalesce("sector", F.lit("")) == "") & industry.contains(key), name).otherwise(sector)
    found = F.size("_d") > 0
    return (
        company.withColumns({"position": position, "risks": risks, "_d": drivers, "sector": sector})
        .withColumns(
            {
                "potential": F.when(found, "较高").otherwise("中等"),
                "drivers": F.when(found, F.col("_d")).otherwise(F.array(F.lit("行业自然增长"))),
            }
        )
        .drop("_d")
    )
