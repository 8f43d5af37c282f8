"""Word lists, aliases, policies. They must equal the domain's own for right results."""

PLATFORM_CODES = {"xiaohongshu": "xhs", "xhs": "xhs", "douyin": "dy", "dy": "dy", "bilibili": "bili", "bili": "bili", "weibo": "wb", "wb": "wb", "kuaishou": "ks", "ks": "ks", "tieba": "tieba", "zhihu": "zhihu"}
PLATFORM_LABELS = {"xhs": "xiaohongshu", "dy": "douyin", "bili": "bilibili", "wb": "weibo", "ks": "kuaishou", "tieba": "tieba", "zhihu": "zhihu"}
SIGNAL_LABELS = {"xhs": "xiaohongshu", "dy": "douyin", "bili": "bilibili", "wb": "weibo", "ks": "kuaishou"}
REFERENCE_SOURCES = ("taobao", "industry_news")
DEFAULT_TARGETS = ("xiaohongshu", "douyin", "bilibili")

#: Query suffixes: (goal or trend type, platform) to (expansion type, suffix) pairs in order.
GOAL_SUFFIXES = {
    ("trend_discovery", "xiaohongshu"): (("domain_constraint", "护肤"), ("scenario_binding", "趋势")),
    ("trend_discovery", "douyin"): (("platform_style", "趋势"), ("domain_constraint", "成分")),
    ("trend_discovery", "bilibili"): (("platform_style", "教程"), ("platform_style", "科普")),
    ("market_validation", "xiaohongshu"): (("platform_style", "测评"), ("category_binding", "推荐")),
    ("market_validation", "douyin"): (("platform_style", "推荐"), ("category_binding", "热度")),
    ("market_validation", "bilibili"): (("platform_style", "测评"), ("platform_style", "推荐")),
    ("risk_monitoring", "xiaohongshu"): (("risk_probe", "风险"), ("risk_probe", "避雷"), ("risk_probe", "副作用")),
    ("risk_monitoring", "douyin"): (("risk_probe", "风险"), ("risk_probe", "翻车"), ("risk_probe", "避雷")),
    ("risk_monitoring", "bilibili"): (("risk_probe", "避雷"), ("risk_probe", "副作用"), ("risk_probe", "风险")),
}
TYPE_SUFFIXES = {
    ("ingredient", "xiaohongshu"): (("domain_constraint", "护肤"), ("category_binding", "成分")),
    ("ingredient", "douyin"): (("domain_constraint", "成分"), ("category_binding", "原料")),
    ("ingredient", "bilibili"): (("domain_constraint", "成分"), ("platform_style", "科普")),
    ("claim", "xiaohongshu"): (("domain_constraint", "功效"), ("platform_style", "护肤")),
    ("claim", "douyin"): (("platform_style", "功效"), ("platform_style", "推荐")),
    ("claim", "bilibili"): (("platform_style", "功效"), ("platform_style", "实测")),
    ("category", "xiaohongshu"): (("platform_style", "测评"), ("category_binding", "推荐")),
    ("category", "douyin"): (("platform_style", "推荐"), ("platform_style", "热度")),
    ("category", "bilibili"): (("platform_style", "测评"), ("platform_style", "合集")),
    ("scenario", "xiaohongshu"): (("scenario_binding", "护肤"), ("scenario_binding", "场景")),
    ("scenario", "douyin"): (("platform_style", "热门"), ("scenario_binding", "分享")),
    ("scenario", "bilibili"): (("scenario_binding", "教程"), ("scenario_binding", "干货")),
    ("risk_compliance", "xiaohongshu"): (("risk_probe", "风险"), ("risk_probe", "避雷")),
    ("risk_compliance", "douyin"): (("risk_probe", "风险"), ("risk_probe", "翻车")),
    ("risk_compliance", "bilibili"): (("risk_probe", "避雷"), ("risk_probe", "副作用")),
}
EXTRA_RISK = ("risk_probe", "风险")
REFERENCE_SUFFIXES = {
    ("industry_news", "trend_discovery"): ("行业趋势", "原料创新"),
    ("industry_news", "market_validation"): ("市场洞察", "行业分析"),
    ("industry_news", "risk_monitoring"): ("法规", "争议"),
    ("taobao", "trend_discovery"): ("精华", "护肤品"),
    ("taobao", "market_validation"): ("产品", "类目"),
    ("taobao", "risk_monitoring"): ("护肤品", "功效"),
}

RISK_HIGH = ("治疗", "医美", "激素", "处方", "注射")
RISK_MEDIUM = ("祛斑", "敏感", "功效", "抗衰", "孕妇")
NEGATIVE_HINTS = ("曝光", "避雷", "风险", "副作用", "骗局", "三无", "虚假", "神药")
POSITIVE_HINTS = ("推荐", "教程", "干货", "分享", "测评", "好用", "入门")
RETRYABLE = ("timeout", "network", "connection", "temporary", "rate", "retry")

#: Minutes by tier: revisit, revisit on xhs, cooldown, cooldown on xhs.
TIERS = {
    "watchlist-hot": (12 * 60, 24 * 60, 24 * 60, 72 * 60),
    "watchlist-normal": (24 * 60, 48 * 60, 24 * 60, 72 * 60),
    "discovery": (3 * 24 * 60, 7 * 24 * 60, 12 * 60, 72 * 60),
}
TTL_DAYS = {"watchlist-hot": 14, "watchlist-normal": 30, "discovery": 60}
#: Days after which a keyword of a period type is due again.
DUE_DAYS = {"monthly": 30, "annual": 365, "special_topic": 90, "cross_period": 180}
URL_KEYS = ("source_url", "url", "note_url", "share_url", "jump_url")
