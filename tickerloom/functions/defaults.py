"""Default lexicons and constants. Every operator takes these as arguments."""

# Sector name -> column suffix of the daily news features.
SECTOR_SLUGS = {
    "银行": "bank",
    "证券": "broker",
    "保险": "insurance",
    "地产": "real_estate",
    "汽车": "auto",
    "科技": "technology",
    "医药": "healthcare",
    "消费": "consumer",
    "能源": "energy",
    "军工": "defense",
    "基建": "infrastructure",
    "传媒": "media",
    "教育": "education",
    "农业": "agriculture",
    "交通": "transport",
    "白酒": "baijiu",
    "家电": "home_appliance",
}

# Substring of "sector industry" -> stock_sector_* column suffix.
STATIC_SECTOR_SLUGS = {
    "金融": "financial",
    "消费": "consumer",
    "地产": "real_estate",
    "交通": "transport",
    "制造": "manufacturing",
    "医疗": "healthcare",
    "科技": "technology",
    "能源": "energy",
}

# Event phrase -> event_*_count column suffix.
EVENT_SLUGS = {
    "央行降准": "rrr_cut",
    "央行降息": "rate_cut",
    "IPO": "ipo",
    "财报发布": "earnings_report",
    "政策利好": "policy_positive",
    "政策利空": "policy_negative",
    "并购重组": "mna",
    "业绩预增": "earnings_positive",
    "业绩预减": "earnings_negative",
    "高管增持": "insider_buy",
    "高管减持": "insider_sell",
}

# Fixed values: (event phrase, impact, duration in days, sectors).
EVENT_FACTORS = [
    ("央行降准", 0.8, 5, ["银行", "证券"]),
    ("央行降息", 0.7, 5, ["银行", "地产"]),
    ("IPO", 0.3, 2, ["证券"]),
    ("财报发布", 0.5, 3, []),
    ("政策利好", 0.6, 4, []),
    ("政策利空", -0.6, 4, []),
    ("并购重组", 0.7, 7, []),
    ("业绩预增", 0.5, 3, []),
    ("业绩预减", -0.5, 3, []),
    ("高管增持", 0.3, 2, []),
    ("高管减持", -0.3, 2, []),
]

# News category -> trigger words, and the fallback category.
CATEGORY_TERMS = {
    "财经": ["财经", "经济", "金融", "投资", "理财"],
    "股票": ["股票", "A股", "港股", "美股", "股市"],
    "基金": ["基金", "ETF", "公募", "私募"],
    "债券": ["债券", "国债", "企业债"],
    "期货": ["期货", "大宗", "商品"],
    "外汇": ["外汇", "汇率", "人民币", "美元"],
    "银行": ["银行", "存款", "贷款", "利率"],
    "保险": ["保险", "寿险", "财险"],
    "宏观": ["宏观", "GDP", "CPI", "PMI", "政策"],
    "公司": ["公司", "企业", "财报", "业绩"],
}
OTHER_CATEGORY = "其他"

# Sector -> trigger words.
SECTOR_TERMS = {
    "银行": ["银行", "贷款", "存款", "利率", "LPR"],
    "证券": ["证券", "券商", "投行", "IPO", "上市"],
    "保险": ["保险", "寿险", "财险", "养老金"],
    "地产": ["房地产", "楼盘", "房价", "土地", "万科"],
    "汽车": ["汽车", "新能源车", "电动车", "比亚迪", "特斯拉"],
    "科技": ["科技", "人工智能", "AI", "芯片", "半导体"],
    "医药": ["医药", "医疗", "生物", "疫苗", "创新药"],
    "消费": ["消费", "零售", "电商", "白酒", "食品"],
    "能源": ["能源", "石油", "天然气", "新能源", "光伏"],
    "军工": ["军工", "国防", "航空", "航天"],
    "基建": ["基建", "建筑", "工程", "水泥", "钢铁"],
    "传媒": ["传媒", "影视", "游戏", "广告"],
    "教育": ["教育", "培训", "学校"],
    "农业": ["农业", "粮食", "种子", "养殖"],
}

# Sentiment words with weights.
POSITIVE_WORDS = {
    "上涨": 1.1,
    "增长": 1.0,
    "盈利": 1.0,
    "突破": 1.0,
    "创新高": 1.2,
    "利好": 1.2,
    "增持": 0.9,
    "回购": 1.0,
    "分红": 0.8,
    "超预期": 1.2,
    "领涨": 0.9,
    "涨停": 1.0,
    "高景气": 1.1,
    "订单充足": 1.0,
    "业绩预增": 1.0,
}
NEGATIVE_WORDS = {
    "下跌": 1.1,
    "亏损": 1.2,
    "暴跌": 1.3,
    "利空": 1.2,
    "减持": 1.0,
    "质押": 0.8,
    "违约": 1.3,
    "退市": 1.4,
    "熊市": 1.0,
    "跌停": 1.1,
    "下滑": 1.0,
    "预警": 0.9,
    "风险": 0.8,
    "诉讼": 0.8,
    "处罚": 1.0,
    "调查": 0.8,
    "爆雷": 1.3,
}
NEGATION_WORDS = ["不", "未", "无", "并非", "否认", "难以", "不能", "没有"]
INTENSIFY_WORDS = ["显著", "大幅", "强劲", "持续", "明显", "急剧", "再度", "全面"]
UNCERTAIN_WORDS = ["或", "可能", "预计", "或将", "传闻", "据悉", "传", "拟"]
POSITIVE_PATTERNS = [
    "同比增长",
    "环比增长",
    "扭亏为盈",
    "业绩超预期",
    "签订大单",
    "获批",
    "政策支持",
    "回购计划",
]
NEGATIVE_PATTERNS = [
    "同比下滑",
    "环比下滑",
    "业绩不及预期",
    "暂停上市",
    "被立案调查",
    "终止合作",
    "大幅亏损",
    "减值损失",
]

# Title words that raise importance by 0.1 each.
IMPORTANT_TITLE_WORDS = [
    "央行",
    "证监会",
    "发改委",
    "国务院",
    "政策",
    "降准",
    "降息",
    "IPO",
    "重组",
    "并购",
    "财报",
]

# Company-name suffixes, stripped in this order.
COMPANY_SUFFIXES = ["股份有限公司", "集团股份有限公司", "有限公司", "股份", "集团", "控股", "A股", "A", "B", "H"]

# Article URL shapes, page selectors and the date pattern of listing pages.
ARTICLE_URL_PATTERNS = [
    r"/\d{8}/\d+\.shtml(?:$|\?)",
    r"/\d{4}/\d{2}/\d{2}/\d+\.shtml(?:$|\?)",
    r"/\d{6,8}\.shtml(?:$|\?)",
    r"\.shtml(?:$|\?)",
]
ITEM_SELECTORS = [
    "div.channel_list.cj_list div.ls_news_c.ls_news_r",
    "div.ls_news_c.ls_news_r",
    "div.ls_news",
    "ul.head_news li",
    "article",
    "div.news-item",
    "li",
]
TITLE_SELECTORS = ["a.ls_news_tit", "h3 a", "h2 a", "a"]
DATE_SELECTORS = ["span.list_time", "time", ".time", ".date"]
LISTING_DATE_PATTERN = r"(20\d{2}[-/.年]\d{1,2}[-/.月]\d{1,2})"

# Column groups of the panel.
TECHNICAL_COLUMNS = [
    "ret_1d",
    "ret_5d",
    "ret_20d",
    "vol_5d",
    "vol_20d",
    "rsi",
    "macd",
    "bb_position",
    "ma5_gt_ma10",
    "ma10_gt_ma20",
    "volume_ratio",
]
NEWS_COLUMNS = [
    "news_count",
    "avg_sentiment",
    "weighted_sentiment",
    "avg_importance",
    "max_importance",
    "positive_ratio",
    "negative_ratio",
    "source_count",
    "source_entropy",
    "news_impact_total",
    "news_impact_abs_total",
    "news_sentiment_abs_sum",
    "event_shock_flag",
    "sentiment_ewm_3d",
    "sentiment_ewm_5d",
    "importance_ewm_3d",
    "importance_ewm_5d",
    "news_count_ewm_5d",
    "impact_ewm_5d",
]
NON_FEATURES = ["date", "trade_date", "stock_code", "stock_name", "future_ret_5d", "label_up_5d"]

# Words of the text statistics, sector order of the predictor, industry -> sector.
TEXT_POSITIVE = ["增长", "利好", "上涨", "增持", "突破", "回购", "盈利", "超预期", "高景气", "订单"]
TEXT_NEGATIVE = ["下滑", "利空", "下跌", "减持", "亏损", "风险", "处罚", "违约", "暴雷", "裁员"]
PREDICTOR_SECTORS = [
    "银行", "证券", "保险", "地产", "汽车", "科技", "医药", "消费", "能源", "军工", "基建", "传媒", "教育", "农业", "交通",
]
INDUSTRY_SECTORS = {
    "银行": "金融",
    "证券": "金融",
    "保险": "金融",
    "白酒": "消费",
    "家电": "消费",
    "房地产": "地产",
    "机场": "交通",
    "汽车": "制造",
    "医药": "医疗",
    "科技": "科技",
    "能源": "能源",
}
SOURCE_ALIASES = {
    "东方财富": "eastmoney",
    "财经新闻": "eastmoney",
    "新浪": "sina",
    "新浪财经": "sina",
    "腾讯": "tencent",
    "腾讯财经": "tencent",
}

# Fixed values: (metric of the candidate, metric of the baseline), first comparable pair wins.
GATE_METRICS = [
    ("test_prediction_auc", "auc"),
    ("test_auc", "auc"),
    ("test_prediction_accuracy", "accuracy"),
    ("test_accuracy", "accuracy"),
    ("val_prediction_auc", "auc"),
    ("val_auc", "auc"),
    ("val_prediction_accuracy", "accuracy"),
    ("val_accuracy", "accuracy"),
]
