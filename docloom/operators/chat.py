"""Conversation windows, turn splitting, routing rules and roll-ups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

#: Terms of the rule that sends a question to customer service.
MANUAL_TERMS = [
    "如何", "怎么", "步骤", "操作", "使用", "安装", "拆卸", "更换", "调节", "调整", "启动", "关闭", "清洁", "连接", "设置", "充电", "故障排除", "troubleshooting", "steps", "how to",
    "what are", "manual", "snowmobile", "television", "toothbrush", "吹风机", "空调", "遥控器", "摩托艇", "水泵", "温控器", "vr", "键盘", "电动摩托车", "鼠标", "烤箱", "相机",
    "电钻", "冰箱", "牙刷",
]
CUSTOMER_TERMS = [
    "7天无理由", "退货", "换货", "退款", "运费", "发票", "物流", "快递", "包装破损", "投诉", "虚假宣传", "少发", "补发", "保质期", "临期", "客服", "售后", "维修服务", "赔偿", "赔付", "订单", "付款",
    "签收", "人工客服", "假货", "二手", "划痕", "瑕疵", "色差", "上门安装服务", "试用装", "优惠券", "以旧换新",
]
PURCHASE_TERMS = [
    "收到", "购买", "你们", "商品", "订单", "退款", "投诉",
]

#: Terms and separators of the clause extractor.
CLAUSE_MANUAL_TERMS = [
    "如何", "怎么", "怎样", "步骤", "安装", "清洁", "更换", "使用", "操作", "设置", "启动", "关闭", "充电", "滤网", "节能模式", "energy saving", "clean", "install", "replace", "use",
    "operate", "filter",
]
CLAUSE_CUSTOMER_TERMS = [
    "发票", "退款", "退货", "退换货", "运费", "售后", "维修政策", "refund", "invoice", "after-sales", "return policy",
]
SEPARATORS = [
    "另外", "此外", "同时", "并且", "而且", "还有", "顺便", "also", "and also",
]

ROUTE_THRESHOLD = 0.55


def any_of(text: Column, terms: list[str]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))


def rule_customer_service(text: Column, question_id: Column, manual=MANUAL_TERMS, customer=CUSTOMER_TERMS, purchase=PURCHASE_TERMS) -> Column:
    """A number under 64 decides; else customer terms without manual terms, or
    with purchase terms."""
    number = question_id.try_cast("int")
    c, m, p = any_of(text, customer), any_of(text, manual), any_of(text, purchase)
    return F.coalesce(number < 64, F.lit(False)) | (c & (~m | p))


def arbitrate(rule: Column, strong: Column, intent: Column, confidence: Column) -> Column:
    """Rule or model: the rule where its id is strong, where the model gave no
    plan or little confidence, or where only the rule says customer service."""
    by_rule = F.when(rule, "customer_service").otherwise("manual")
    return F.when(strong | intent.isNull() | (confidence < ROUTE_THRESHOLD), by_rule).when(rule & (intent != "customer_service"), by_rule).otherwise(intent)


def clauses(text: Column, manual=CLAUSE_MANUAL_TERMS, customer=CLAUSE_CUSTOMER_TERMS, separators=SEPARATORS) -> Column:
    """Clauses that ask about use, of texts that also ask customer service."""
    cut = text  # separators take effect one after another, as a later one may hold an earlier one
    for word in separators:
        cut = F.regexp_replace(cut, "(?iu)" + re.escape(word), "\x01")
    parts = F.transform(F.split(cut, "[\x01？?。.;；,，]"), lambda s: F.regexp_replace(T.clean_turn(s), "^[ ，,。.;；]+|[ ，,。.;；]+\\z", ""))
    kept = F.filter(parts, lambda s: (s != "") & F.exists(F.array(*map(F.lit, manual)), lambda t: F.contains(F.lower(s), t)))
    asked = F.transform(kept, lambda s: F.concat(s, F.when(s.rlike("[？?。.]\\z"), "").when(s.rlike(T.CJK), "？").otherwise("?")))
    return F.when(any_of(text, manual) & any_of(text, customer), F.array_distinct(asked)).otherwise(F.array().cast("array<string>"))


def last_user_turns(messages: DataFrame, n: int, key: str = "conv_id", seq: str = "turn") -> DataFrame:
    """The suffix from the n-th last user message on; all, if there are fewer."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    seen = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)
    return messages.withColumn("_seen", seen).where((F.col("_seen") < n) | ((F.col("_seen") == n) & (F.col("role") == "user"))).drop("_seen")


def rollup(tasks: DataFrame, key: list[str]) -> DataFrame:
    """``tasks(key..., task_id, answer, image_ids, agent)``: ordered answers that
    are not empty, distinct images in order, one agent's name or ``mixed``."""
    t = F.array_sort(F.collect_list(F.struct("task_id", "answer", "image_ids")))
    g = tasks.groupBy(*key).agg(t.alias("t"), F.count_distinct("agent").alias("n"), F.max("agent").alias("agent"))
    answers = F.filter(F.transform("t", lambda x: x["answer"]), lambda a: a != "")
    return g.select(*key, F.array_join(answers, "\n").alias("answer"), F.array_distinct(F.flatten(F.transform("t", lambda x: x["image_ids"]))).alias("image_ids"), F.when(F.col("n") == 1, F.col("agent")).otherwise("mixed").alias("agent"))
