"""Routing of questions by rules: intent, keyword and topic, and whether the rules understood every word."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signals of intents in order of precedence, of questions that need more than one step, of follow-ups, and words without a topic.
INTENTS = {"risk_analysis": ("风险", "预警", "危险", "负面"), "report": ("简报", "报告", "总结"), "opinion_answer": ("怎么看", "大家怎么看", "观点", "看法"), "hotspots": ("热点", "讨论最多", "热度", "热门")}
COMPLEX = (
    "对比", "比较", "相比", "对照", "vs", "VS",
    "哪个", "哪一个", "谁更", "更高", "更多", "更严重", "更值得", "更好", "更差",
    "结合", "综合", "整体判断", "分别", "各自", "多方面", "多维度", "多个", "几个",
    "同时", "以及", "还有", "并且", "此外", "另外", "先", "和", "与", "跟", "、",
)
FOLLOW_UP = ("再", "继续", "接着", "刚才", "刚刚", "刚说", "上面", "上述", "上一个", "上一轮", "之前", "前面", "那个", "这个", "展开", "详细", "细说", "补充")
FILLER = (
    "同学们", "同学", "老师", "大家", "咱们", "我们", "你们", "我", "你", "您", "请", "麻烦", "帮我", "帮忙", "帮", "给我", "给",
    "想要", "想", "需要", "要", "能不能", "可不可以", "可以", "能", "一份", "一个", "一下", "一点", "一些", "有些", "份", "个", "些", "点",
    "最近", "近期", "近来", "现在", "目前", "当前", "如今", "今天", "最新", "这段时间", "前段时间", "这几天", "这两天", "本周", "一周", "近况",
    "什么", "啥", "怎么样", "怎样", "如何", "多少", "有没有", "是不是", "哪些", "到底", "究竟",
    "生成", "出具", "整理", "汇总", "分析", "看看", "说说", "讲讲", "讲", "说", "写", "做", "出", "查查", "查", "搜索", "搜", "了解", "知道", "关注", "反映", "反馈",
    "舆情", "情况", "话题", "事件", "问题", "内容", "讨论", "评价", "消息", "新闻", "动态", "数据", "方面", "相关", "学校", "校园", "学院",
    "的", "了", "吗", "呢", "吧", "啊", "呀", "嘛", "么", "是", "有", "没有", "没", "在", "里", "中", "上", "对于", "对", "关于", "有关", "针对",
    "就", "都", "也", "还", "很", "挺", "太", "非常", "具体", "主要", "严重", "厉害", "高", "低", "大", "小", "多", "少", "这一", "这", "那", "此",
)
LONGEST = 30


def _has(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def _without(text: Column, words: Sequence[str]) -> Column:
    """The text after each word in turn, long ones first, was taken out."""
    order = sorted(set(words), key=lambda w: (-len(w), w))
    return F.aggregate(F.array(*map(F.lit, order)), text, lambda t, w: F.replace(t, w, F.lit("")))


def route(message: Column, keywords: Sequence[str]) -> Column:
    """struct(intent, keyword, topic, confident) of a question.

    intent is the first whose signal is there, else search; keyword the longest known one;
    topic is switch with a keyword, continue with a follow-up signal, else global. The rules are
    confident of a short question with one intent and one keyword at most, without signals of a
    comparison or a follow-up, in which nothing is left once all known words are taken out.
    """
    text = F.trim(F.coalesce(message, F.lit("")))
    found = F.array_compact(F.array(*(F.when(_has(text, words), F.lit(name)) for name, words in INTENTS.items())))
    known = sorted(dict.fromkeys(keywords), key=lambda k: -len(k))
    hits = F.filter(F.array(*map(F.lit, known)), lambda k: F.contains(text, k))
    own = F.filter(hits, lambda k: ~F.exists(hits, lambda o: (o != k) & F.contains(o, k)))
    keyword = F.coalesce(F.get(hits, F.lit(0)), F.lit(""))
    topic = F.when(keyword != "", "switch").when(_has(text, FOLLOW_UP), "continue").otherwise("global")
    rest = F.aggregate(own, text, lambda t, k: F.replace(t, k, F.lit("")))
    rest = _without(_without(rest, [w for words in INTENTS.values() for w in words]), FILLER)
    rest = F.regexp_replace(rest, r"[\p{P}\s　~<>|·]", "")
    sure = (text != "") & (F.length(text) <= LONGEST) & ~_has(text, COMPLEX) & ~_has(text, FOLLOW_UP) & (F.size(found) == 1) & (F.size(own) <= 1) & (rest == "")
    return F.struct(F.coalesce(F.get(found, F.lit(0)), F.lit("search")).alias("intent"), keyword.alias("keyword"), topic.alias("topic"), sure.alias("confident"))
