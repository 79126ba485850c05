"""Heat, recency, growth, risk and priority of posts and events, as column expressions.

`now` is always given; an unknown time is not an old one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearsay.functions.text import word_hits

HALF_LIFE, WINDOW, LEAST_RECENT = 21.0, 21.0, 2
# Weights of the ranking.
SEVERITY = {"high": 9.0, "medium": 3.0, "low": 1.0}
LIFECYCLE = {"escalating": 4.0, "ongoing": 2.0, "resolved": 0.5, "not_applicable": 0.5}
PLATFORM = {"xhs": 1.0, "ks": 0.9, "web": 0.8, "tieba": 0.6, "zhihu": 0.5, "weibo": 0.4}
# Word lists of the rule scorer.
NEGATIVE = ("不稳定", "断供", "断", "太久", "排队", "涨价", "误会", "投诉", "诈骗", "别点", "冲突", "压力", "暗", "不太安心", "陌生人", "尾随", "担心", "影响", "问题", "意见", "故障", "风险", "焦虑")
POSITIVE = ("不错", "恢复", "改善", "接受", "好", "提醒", "明确", "清楚", "安全感", "官方", "参加", "开放", "统一处理", "很快")
HIGH_RISK = ("诈骗", "银行卡", "验证码", "陌生人", "尾随", "缴费链接")
RISK_TOPIC = ("校园安全", "防诈骗", "短信", "缴费", "路灯", "夜间", "巡逻", "门禁", "宿舍", "热水", "食堂", "卫生", "课程安排", "课表", "考试", "选课", "教务", "作业")
CONCERNS = {"宿舍后勤服务": ("宿舍", "热水", "维修", "洗衣房", "后勤"), "食堂服务体验": ("食堂", "饭堂", "排队", "价格", "卫生", "错峰"), "课程与教务安排": ("课程安排", "课表", "考试", "选课", "补退选", "教务", "作业"), "校园安全风险": ("校园安全", "诈骗", "防诈骗", "短信", "缴费", "路灯", "夜间", "巡逻", "门禁", "陌生人")}


def weight(key: Column, table: Mapping[str, float], default: float = 1.0) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), key), F.lit(default))


def heat_score(likes: Column, collects: Column, comments: Column, shares: Column) -> Column:
    """Likes, 1.5 times collects, 3 times comments and 2.5 times shares, each 0 at least; two decimals."""
    own = [F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in (likes, collects, comments, shares)]
    return F.round(own[0] + own[1] * 1.5 + own[2] * 3.0 + own[3] * 2.5, 2).cast("double")


def kept_heat(stored: Column, computed: Column) -> Column:
    """The stored heat where all counters give 0."""
    return F.when(computed == 0, F.coalesce(stored, F.lit(0.0))).otherwise(computed)


def ranking_score(platform: Column, heat_rank: Column, table: Mapping[str, float] = PLATFORM) -> Column:
    return F.round(weight(platform, table) * heat_rank, 4)


def age_days(at: Column, now: Column) -> Column:
    """Days from a time to now, null if the time is unknown."""
    return (F.unix_micros(now) - F.unix_micros(at)) / F.lit(86400e6)


def recency_weight(age: Column, half_life: float = HALF_LIFE) -> Column:
    """Halves with each half life, between 1e-6 and 1; unknown or future times weigh 1."""
    if half_life <= 0:
        return F.lit(1.0)
    return F.when(age.isNull() | (age < 0), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(1e-6), F.pow(F.lit(0.5), age / half_life))))


def growth(times: Column, now: Column, window: float = WINDOW, least: int = LEAST_RECENT) -> Column:
    """struct(recent, prior, prior_days, growing) of an array of times.

    Posts grow if at least `least` fall in the window before now, and at a rate a day no lower
    than that of the time before. Future and null times are left out.
    """
    age = F.filter(F.transform(times, lambda t: age_days(t, now)), lambda a: a.isNotNull() & (a >= 0))
    recent = F.size(F.filter(age, lambda a: a <= window))
    prior = F.size(age) - recent
    days = F.greatest(F.coalesce(F.array_max(age), F.lit(0.0)) - window, F.lit(window))
    return F.struct(recent.alias("recent"), prior.alias("prior"), days.alias("prior_days"), ((recent >= least) & (recent / F.lit(window) >= prior / days)).alias("growing"))


def growth_of(at: Column, now: Column, window: float = WINDOW, least: int = LEAST_RECENT) -> Column:
    """growth as an aggregate over rows with a time each, so that no group's times are gathered."""
    age = age_days(at, now)
    recent, prior = F.count_if((age >= 0) & (age <= window)), F.count_if(age > window)
    days = F.greatest(F.coalesce(F.max(F.when(age >= 0, age)), F.lit(0.0)) - window, F.lit(window))
    return F.struct(recent.alias("recent"), prior.alias("prior"), days.alias("prior_days"), ((recent >= least) & (recent / F.lit(window) >= prior / days)).alias("growing"))


def effective_lifecycle(base: Column, growing: Column) -> Column:
    """An ongoing event that grows escalates; a stored 'escalating' counts as ongoing first."""
    own = F.when(base == "escalating", "ongoing").otherwise(base)
    return F.when((own == "ongoing") & growing, "escalating").otherwise(own)


def priority(risk: Column, recency: Column, lifecycle: Column) -> Column:
    return weight(risk, SEVERITY) * recency * weight(lifecycle, LIFECYCLE)


def confidence(n: Column) -> Column:
    return F.least(F.greatest(F.lit(0.5) + F.least(n, F.lit(10)) * 0.05, F.lit(0.0)), F.lit(0.95))


def memory_trend(now: Column, before: Column, ratio: float = 0.05, least: float = 1.0) -> Column:
    """new, rising, falling or stable against the heat before; changes within 5 % or 1 are noise."""
    bound = F.greatest(F.abs(before) * ratio, F.lit(least))
    return F.when(before.isNull(), "new").when(now - before > bound, "rising").when(before - now > bound, "falling").otherwise("stable")


def note_risk(text: Column, sentiment: Column, risk: Column, comments: Column, shares: Column, heat_rank: Column, heat: Column, *, negative: Sequence[str] = NEGATIVE, positive: Sequence[str] = POSITIVE, high_risk: Sequence[str] = HIGH_RISK, topic: Sequence[str] = RISK_TOPIC) -> Column:
    """struct(sentiment, sentiment_score, risk_level, risk_score, reasons) of a post by rules over words, counts and given hints.

    The text is worked out once, and so are its hits, however often the rules use them.
    """
    lists = {"n": negative, "p": positive, "h": high_risk, "t": topic}
    hits = F.transform(F.array(text), lambda x: F.struct(*(F.size(word_hits(x, words)).alias(k) for k, words in lists.items())))
    return F.get(F.transform(hits, lambda c: _risk_of(*(c[k] for k in lists), sentiment, risk, comments, shares, heat_rank, heat)), F.lit(0))


def _risk_of(n: Column, p: Column, h: Column, t: Column, sentiment: Column, risk: Column, comments: Column, shares: Column, heat_rank: Column, heat: Column) -> Column:
    mood = weight(sentiment, {"positive": 2.0, "neutral": 0.0, "negative": -2.0, "controversial": -1.0}, 0.0) + p - n
    label = F.when((n > 0) & (p > 0) & (F.abs(mood) <= 1), "controversial").when(mood <= -2, "negative").when(mood >= 2, "positive").when(n > 0, "negative").when(p > 0, "positive").otherwise("neutral")
    hot = F.when(F.coalesce(heat_rank, F.lit(0.0)) != 0, heat_rank >= 80.0).otherwise(F.coalesce(heat, F.lit(0.0)) >= 150.0)
    parts = ((h > 0, F.least(h * 18, F.lit(45)), "出现安全或诈骗高风险词"), (n > 0, F.least(n * 6, F.lit(24)), "负面反馈词集中"), (t > 0, F.least(t * 4, F.lit(24)), "涉及校园公共事务"), (comments >= 25, F.lit(8), "评论讨论量较高"), (shares >= 10, F.lit(10), "分享传播量较高"), (hot, F.lit(8), "综合热度较高"))
    score = weight(risk, {"low": 0.0, "medium": 32.0, "high": 60.0}, 0.0)
    for when, points, _ in parts:
        score = score + F.when(when, points).otherwise(0)
    score = F.when((h == 0) & (label == "positive"), F.least(score, F.lit(55.0))).otherwise(score)
    level = F.when(score >= 85, "high").when(score >= 35, "medium").otherwise("low")
    reasons = F.array_compact(F.array(*(F.when(when, F.lit(reason)) for when, _, reason in parts)))
    return F.struct(label.alias("sentiment"), mood.cast("double").alias("sentiment_score"), level.alias("risk_level"), F.least(score, F.lit(100.0)).alias("risk_score"), reasons.alias("reasons"))


def concerns(text: Column, rules: Mapping[str, Sequence[str]] = CONCERNS) -> Column:
    """Names of the rules any of whose words a text holds."""
    return F.array_compact(F.array(*(F.when(F.size(word_hits(text, words)) > 0, F.lit(name)) for name, words in rules.items())))


def event_class(text: Column, keyword: Column, rules: Mapping[str, Sequence[str]]) -> Column:
    """The first rule that a text meets, else its keyword, else general."""
    out = F.when(F.coalesce(keyword, F.lit("")) != "", F.concat(F.lit("keyword:"), keyword)).otherwise("general")
    for name, words in reversed(rules.items()):
        out = F.when(F.size(word_hits(text, words)) > 0, name).otherwise(out)
    return out


def event_sentiment(negative: Column, controversial: Column, neutral: Column, positive: Column) -> Column:
    """An event's sentiment from its posts' counts; ties go negative, controversial, neutral, positive."""
    n = negative + controversial + neutral + positive
    top = F.greatest(negative, controversial, neutral, positive)
    return F.when(negative + controversial >= F.greatest(F.lit(2), F.floor(n / 3)), "negative").when(controversial >= 2, "controversial").when(negative == top, "negative").when(controversial == top, "controversial").when(neutral == top, "neutral").otherwise("positive")


def event_risk(top: Column, n_high: Column, n_raised: Column) -> Column:
    """struct(level, score) of an event from its posts' greatest score and their levels."""
    score = F.least(top + F.when(n_high >= 2, 10).otherwise(0) + F.when(n_raised >= 3, 8).otherwise(0), F.lit(100.0))
    return F.struct(F.when(score >= 85, "high").when(score >= 35, "medium").otherwise("low").alias("level"), score.alias("score"))


def web_heat(host: Column, status: Column, official: Column, news: Column) -> Column:
    """Authority of the source (60, 30 or 0) and strength of its verification (40, 15 or 0)."""
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return (F.when(official, 60.0).when(news, 30.0).otherwise(0.0) + F.when(s == "verified", 40.0).when(s == "needs_review", 15.0).otherwise(0.0))


def stored_risk(level: Column, heat: Column) -> Column:
    return F.coalesce(F.nullif(level, F.lit("")), F.when(heat >= 80, "high").when(heat >= 50, "medium").otherwise("low"))
