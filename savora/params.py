"""Every threshold, weight and word list in one place."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

# The scoring model's weights and sentiment intensities.
WEIGHTS = {
    "real_mention_volume": 0.20,
    "sentiment_strength": 0.18,
    "locality": 0.15,
    "price_friendliness": 0.12,
    "tenure": 0.10,
    "non_chain": 0.10,
    "uniqueness": 0.08,
    "paradox_good": 0.07,
}
INTENSITY = {"positive": 1.0, "mixed": 0.5, "neutral": 0.2, "negative": 0.0}

# Word lists for Chinese sources.
ZH_INFLUENCER = ("网红", "打卡", "ins风", "INS风", "必吃榜", "拔草", "爆款", "排队王")
ZH_UNIQUE = ("只有本地人", "本地人才知道", "本地人推荐", "本地人常去", "带朋友", "老饕", "藏在小巷", "巷子里", "苍蝇馆子", "开了很多年")
ZH_PLAIN_ROOM = ("环境一般", "环境很一般", "环境差", "环境简陋", "环境嘈杂", "环境不怎么样", "没装修", "苍蝇馆子", "苍蝇馆", "店面不起眼", "门头不起眼")
ZH_HYGIENE = ("卫生", "不干净", "脏", "苍蝇乱飞")
ZH_CHAIN = ("连锁", "分店", "加盟", "旗舰店")
ZH_AD = ("探店", "商务合作", "商务推广", "团购链接", "合作私信", "点击链接", "优惠券", "限时抢购")


@dataclass(frozen=True)
class Params:
    now: datetime = datetime(2026, 1, 1)
    # scoring
    half_life_days: int = 180
    mention_target: float = 8
    confidence_target: float = 3
    bayes_prior: float = 2.0
    span_target_days: float = 365
    unique_target: float = 2
    paradox_target: float = 1
    price_ceiling: float = 150.0
    influencer_target: float = 3
    hygiene_target: float = 3
    ad_exclude_ratio: float = 0.4
    burst_window_days: int = 7
    burst_min: int = 20
    suspect_multiplier: float = 0.9
    tenure_decade: float = 0.15
    tenure_half_decade: float = 0.08
    mall_words: tuple[str, ...] = ("购物中心", "广场", "大厦", "商场", "百货")
    chain_brands: tuple[str, ...] = ()
    chain_categories: tuple[str, ...] = ("购物中心内", "连锁快餐")
    influencer_words: tuple[str, ...] = ZH_INFLUENCER
    unique_words: tuple[str, ...] = ZH_UNIQUE
    plain_room_words: tuple[str, ...] = ZH_PLAIN_ROOM
    hygiene_words: tuple[str, ...] = ZH_HYGIENE
    chain_words: tuple[str, ...] = ZH_CHAIN
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    # ranking
    top_n: int = 120
    # alignment
    match_threshold: float = 0.85
    review_threshold: float = 0.65
    name_weight: float = 0.7
    address_weight: float = 0.3
    #: Affixes of shop names, and whether white space inside a name goes.
    name_spaces_go: bool = True
    name_prefixes: tuple[str, ...] = ("老字号", "正宗", "老")
    name_suffixes: tuple[str, ...] = ("旗舰店", "总店", "分店", "新店", "老店")
    branch_words: tuple[str, ...] = ("一号店", "一店", "二店", "三店")
    # text
    ad_words: tuple[str, ...] = ZH_AD
    script_class: str = r"一-鿿"
    min_script_ratio: float = 0.5
    max_tokens: int = 512
    overlap_tokens: int = 0
    confidence_min: float = 0.6
    # liveness
    suspect_misses: int = 5
    closed_misses: int = 10
    # analytics
    view_actions: tuple[str, ...] = ("view",)
    takeaway_actions: tuple[str, ...] = ("click", "purchase", "signup")
    max_days: int = 90


#: Parameters of the registered queries, fitted to the driver's tables.
TABLES = Params(
    now=datetime(2001, 12, 1),
    mention_target=40,
    ad_exclude_ratio=0.25,
    burst_window_days=90,
    burst_min=3,
    unique_target=20,
    paradox_target=10,
    influencer_target=60,
    hygiene_target=60,
    top_n=50,
    mall_words=("Mall",),
    chain_brands=("hot plate",),
    influencer_words=("viral", "check-in"),
    unique_words=("locals only", "hidden lane"),
    plain_room_words=("plain room", "no decor"),
    hygiene_words=("dirty", "hygiene"),
    chain_words=("franchise", "flagship"),
    name_spaces_go=False,
    name_prefixes=("old ", "hot "),
    name_suffixes=(" gear",),
    branch_words=("widget",),
    script_class="a-zA-Z",
    ad_words=("licensed", "idiot", "benchmark", "http"),
)
