"""Text functions on columns: cleaning, counts, keywords, tags, labels, URLs, citations. All run in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the Unicode sense, with the zero-width space.
SPACE = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]"

# Label words and their normal forms.
SENTIMENT_LABELS = {"positive": "positive", "正面": "positive", "偏正面": "positive", "neutral": "neutral", "中性": "neutral", "negative": "negative", "负面": "negative", "偏负面": "negative", "controversial": "controversial", "争议": "controversial"}
RISK_LABELS = {"high": "high", "高": "high", "高风险": "high", "medium": "medium", "中": "medium", "中风险": "medium", "low": "low", "低": "low", "低风险": "low"}
# Phrases that try to give a model instructions.
INJECTIONS = (
    r"(忽略|无视|忘记|抛弃)[^。！？\n]{0,12}(指令|提示词?|规则|设定|约束)",
    r"不要(遵守|理会|执行)[^。！？\n]{0,8}(指令|提示|规则|设定)",
    r"从现在开始[，,]?你(必须|要|是|只能)",
    r"(扮演|假装|重新设定)[^。！？\n]{0,8}(角色|身份|系统|管理员)",
    r"(?i)(泄露|输出|打印|告诉我)[^。！？\n]{0,8}(系统提示词?|system ?prompt)",
    r"(?i)ignore\s+(all\s+|the\s+)?(previous|prior|above)\s+(instructions?|prompts?|rules?)",
    r"(?i)disregard\s+(the\s+)?(system\s+)?(prompt|instructions?|rules?)",
    r"(?i)forget\s+(all\s+)?(previous|your)\s+(instructions?|rules?)",
    r"(?i)you\s+are\s+now\s+",
    r"(?i)reveal\s+(your\s+)?(system\s+)?prompt",
    r"(?i)new\s+instructions?\s*[:：]",
)
CITATION = r"[\[【［]\s*来源\s*[:：]\s*([pPeEｐＰｅＥ][0-9０-９]+(?:\s*[,，、]\s*[pPeEｐＰｅＥ][0-9０-９]+)*)\s*[\]】］]"


def clean_text(x: Column) -> Column:
    """Runs of white space, wide and zero-width included, as one space; trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), f"{SPACE}+", " "))


def stripped(x: Column) -> Column:
    """Text without white space at both ends; null as empty."""
    return F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), f"^{SPACE}+|{SPACE}+$", "")


def first_text(*xs: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in xs), F.lit(""))


def _number(x: Column) -> Column:
    return F.regexp_extract(x, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def parse_int(x: Column) -> Column:
    """A count from text that may hold 万 or w (ten thousands), 千 or k anywhere, commas and a plus; 0 if there is none."""
    s = F.lower(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), "[,+]", ""))
    unit = F.when(s.rlike("[万w]"), 10000).when(s.rlike("[千k]"), 1000).otherwise(1)
    return F.coalesce(F.floor(_number(s) * unit).cast("long"), F.lit(0))


def int_count(x: Column) -> Column:
    """A count whose unit, 万 or k, counts only as the last character; 0 if there is none, or if it is negative."""
    s = F.lower(F.replace(stripped(x), F.lit(","), F.lit("")))
    unit = F.when(s.endswith("万"), 10000).when(s.endswith("k"), 1000).otherwise(1)
    return F.greatest(F.coalesce(F.floor(F.regexp_extract(s, r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double") * unit).cast("long"), F.lit(0)), F.lit(0))


# Words beside a count.
COUNT_LABELS = ("次赞", "点赞", "收藏", "评论", "分享", "阅读", "浏览", "播放")


def count_value(x: Column) -> Column:
    """A count that is wholly a number with at most one of 亿万千百, beside label words, commas and a last plus; null otherwise. Fractions are cut off."""
    s = F.regexp_replace(stripped(F.regexp_replace(x.cast("string"), "[,，]|" + "|".join(COUNT_LABELS), "")), rf"\++$", "")
    s = stripped(s)
    pattern = r"^(-?[0-9]+(?:\.[0-9]+)?)([亿万千百]?)$"
    unit = F.regexp_extract(s, pattern, 2)
    times = F.when(unit == "亿", 100000000).when(unit == "万", 10000).when(unit == "千", 1000).when(unit == "百", 100).otherwise(1)
    return F.when(s.rlike(pattern), (F.regexp_extract(s, pattern, 1).try_cast("double") * times).cast("long"))


def first_digits(x: Column) -> Column:
    """The first run of digits, null if none."""
    return F.regexp_extract(x, "([0-9]+)", 1).try_cast("long")


def labelled(x: Column, labels: Mapping[str, str], default: str) -> Column:
    """Normal form of a label word, by its clean lower-case form."""
    table = F.create_map(*(F.lit(v) for kv in labels.items() for v in kv))
    return F.coalesce(F.try_element_at(table, F.lower(clean_text(x))), F.lit(default))


def sentiment_label(x: Column) -> Column:
    return labelled(x, SENTIMENT_LABELS, "neutral")


def risk_label(x: Column) -> Column:
    return labelled(x, RISK_LABELS, "low")


def split_keywords(x: Column) -> Column:
    """Distinct words between commas, # and white space, in order."""
    return F.array_distinct(F.filter(F.split(F.coalesce(x, F.lit("")), rf"(?:[,，#]|{SPACE})+"), lambda w: w != ""))


def word_hits(text: Column, words: Sequence[str]) -> Column:
    """The words that a text contains, in the order of the list."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)) if words else F.array().cast("array<string>")


def keywords_or_hits(x: Column, text: Column, words: Sequence[str]) -> Column:
    """Given keywords, or the words of a dictionary found in the text where none are given."""
    own = split_keywords(x)
    return F.when(F.size(own) > 0, own).otherwise(word_hits(text, words))


def topics(x: Column) -> Column:
    """Distinct topics between two # on a line, 2 to 20 characters, without a last [超话]."""
    found = F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"#([^#\r\n]{1,32})#"), F.lit(1)), lambda t: stripped(F.regexp_replace(stripped(t), r"\[超话\]$", "")))
    return F.array_distinct(F.filter(found, lambda t: F.length(t).between(2, 20)))


def tag_names(x: Column) -> Column:
    """Distinct names of a JSON list of tags: objects with a name, texts, or one text of names between commas; empty for anything else."""
    v = F.try_parse_json(x)
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.transform(F.split(F.try_variant_get(v, "$", "string"), ","), lambda t: F.try_parse_json(F.to_json(F.struct(t.alias("name"))))))
    name = lambda t: F.when(F.schema_of_variant(t).startswith("OBJECT"), F.try_variant_get(t, "$.name", "string")).otherwise(F.try_variant_get(t, "$", "string"))
    kind = F.schema_of_variant(v)
    own = F.when(kind.startswith("ARRAY") | (kind == "STRING"), F.transform(items, lambda t: stripped(name(t))))
    return F.coalesce(F.array_distinct(F.filter(own, lambda t: t != "")), F.array().cast("array<string>"))


def strip_noise(x: Column) -> Column:
    """Without #topic[话题]# marks, @mentions and zero-width characters."""
    s = F.regexp_replace(F.coalesce(x, F.lit("")), r"#[^#\n]{1,40}?(\[话题\])?#", " ")
    s = F.regexp_replace(s, r"@\S+", " ")
    return clean_text(F.regexp_replace(s, r"[​-‍﻿]", ""))


def normal_keyword(x: Column, prefixes: Sequence[str] = (), banned: Sequence[str] = (), longest: int = 12) -> Column:
    """A keyword without emoji, edge punctuation and one of the prefixes; empty if banned, all digits, or not 2 to `longest` long."""
    edge = r"^[\p{P}\s　]+|[\p{P}\s　]+$"
    s = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE00}-\x{FE0F}\x{200D}]", "")
    s = F.regexp_replace(s, edge, "")
    cut = s
    for p in reversed(prefixes):
        cut = F.when(s.startswith(p), F.substring(s, len(p) + 1, 10000)).otherwise(cut)
    s = F.regexp_replace(cut, edge, "")
    return F.when(s.isin(*banned) | (F.length(s) < 2) | (F.length(s) > longest) | s.rlike("^[0-9]+$"), "").otherwise(s) if banned else F.when((F.length(s) < 2) | (F.length(s) > longest) | s.rlike("^[0-9]+$"), "").otherwise(s)


def json_names(x: Column) -> Column:
    """Names from a JSON list of objects with a name, of strings, or from a comma-separated string; distinct, in order."""
    objects = F.transform(F.from_json(x, "array<struct<name:string>>"), lambda e: e["name"])
    strings = F.from_json(x, "array<string>")
    plain = F.when(~F.startswith(F.trim(x), F.lit("[")), F.split(x, "[,，]"))
    named = F.filter(objects, lambda n: n.isNotNull())
    got = F.when(F.size(named) > 0, named).otherwise(F.coalesce(F.filter(strings, lambda s: ~F.startswith(s, F.lit("{"))), plain, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(got, lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != "")))


def fallback_id(platform: Column, url: Column, title: Column, content: Column) -> Column:
    """An id for a post without one: a hash of what it has."""
    parts = [F.coalesce(c, F.lit("")) for c in (platform, url, title, content)]
    return F.concat(F.lit("generated:"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 20))


def bare_id(x: Column) -> Column:
    """What follows the first colon, or all without one."""
    return F.regexp_replace(x, "^[^:]*:", "")


def host_of(url: Column) -> Column:
    """Lower-case host of an http URL, empty otherwise."""
    return F.lower(F.regexp_extract(F.trim(url), r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def canonical_url(url: Column, tracking: Sequence[str] = ("spm", "from")) -> Column:
    """One form for URLs of the same page; null for what is no plain http URL.

    Host and scheme in lower case, no default port, fragment, tracking parameter or closing
    slash (a root path stays /); parameters sorted by name and value, duplicates kept. White
    space within and credentials make a URL invalid.
    """
    s = F.trim(url)
    pattern = r"^(?i)(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    scheme, host = F.lower(F.regexp_extract(s, pattern, 1)), F.lower(F.regexp_extract(s, pattern, 2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    path = F.regexp_extract(s, pattern, 3)
    path = F.when(F.regexp_replace(path, "/+$", "") == "", "/").otherwise(F.regexp_replace(path, "/+$", ""))
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    query = F.filter(F.split(F.regexp_extract(s, pattern, 4), "&"), lambda p: (p != "") & ~F.startswith(name(p), F.lit("utm_")) & ~name(p).isin(*tracking))
    query = F.array_join(F.array_sort(query), "&")
    ok = s.rlike(pattern) & ~s.rlike(SPACE) & ~F.contains(host, F.lit("@"))
    return F.when(ok, F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def url_hash(url: Column) -> Column:
    return F.sha2(canonical_url(url), 256)


def domain_allowed(host: Column, domains: Sequence[str]) -> Column:
    """Whether a host is one of the domains or below it; a leading *. on a domain asks for below only."""
    out = F.lit(False)
    for d in domains:
        out = out | host.endswith("." + d.removeprefix("*."))
        if not d.startswith("*."):
            out = out | (host == d)
    return F.coalesce(out, F.lit(False))


def url_params(url: Column) -> Column:
    """Parameters of a URL as a map; of a repeated name the last counts."""
    pair = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: F.contains(p, F.lit("=")))
    names = F.array_distinct(F.transform(pair, lambda p: F.substring_index(p, "=", 1)))
    value = lambda k: F.element_at(F.filter(pair, lambda p: F.substring_index(p, "=", 1) == k), F.lit(-1))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.regexp_replace(value(k), "^[^=]*=", "")))


def strip_tags(html: Column) -> Column:
    """Without scripts, styles and tags, common entities decoded."""
    s = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]*>", " ")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("middot", "·"), ("copy", "©"), ("amp", "&")):
        s = F.replace(s, F.lit(f"&{name};"), F.lit(char))
    return s


def squeezed(x: Column) -> Column:
    """Without any white space, for comparing quotes."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), SPACE, "")


def quote_found(html: Column, quote: Column, least: int = 12) -> Column:
    """Whether a page shows a quote, or its first `least` characters where it is longer; blank quotes are never found."""
    page, q = squeezed(strip_tags(html)), squeezed(quote)
    return (q != "") & (F.contains(page, q) | ((F.length(q) > least) & F.contains(page, F.substring(q, 1, least))))


def injections(x: Column) -> Column:
    """Phrases of a text that try to instruct a model."""
    return F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(p), F.lit(0)) for p in INJECTIONS)))


def sanitized(x: Column, mark: str = "[已过滤可疑指令]") -> Column:
    """With such phrases replaced by a mark, and data fences that a text opens or closes made harmless."""
    s = F.coalesce(x, F.lit(""))
    for p in INJECTIONS:
        s = F.regexp_replace(s, p, mark.replace("[", r"\[").replace("]", r"\]"))
    s = F.regexp_replace(s, r"(?i)</\s*data\s*>", "＜/data＞")
    return F.regexp_replace(s, r"(?i)<\s*data\s*>", "＜data＞")


def citation_ids(x: Column) -> Column:
    """Cited ids in order with repeats, in lower case and plain digits."""
    group = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(CITATION), F.lit(1))
    ids = F.flatten(F.transform(group, lambda g: F.split(g, r"\s*[,，、]\s*")))
    return F.transform(ids, lambda i: F.lower(F.translate(i, "０１２３４５６７８９ｐＰｅＥ", "0123456789pPeE")))


def json_object(x: Column) -> Column:
    """From the first { to the last }, null if there is none."""
    return F.nullif(F.regexp_extract(x, r"(?s)(\{.*\})", 1), F.lit(""))


def combined(*parts: tuple[str, Column]) -> Column:
    """Labelled lines of the parts that are not blank."""
    return F.concat_ws("\n", *(F.when(clean_text(c) != "", F.concat(F.lit(f"{label}: "), clean_text(c))) for label, c in parts))


def keyword_with_topic(keyword: Column, prefix: str, terms: Sequence[str]) -> Column:
    """The keyword, with the prefix before it unless one of the terms is in it."""
    has = F.lit(False)
    for t in terms:
        has = has | F.contains(F.lower(keyword), F.lit(t.lower()))
    return F.when(has, keyword).otherwise(F.concat(F.lit(prefix), F.lit(" "), keyword))


def matches_topic(text: Column, terms: Sequence[str]) -> Column:
    """Whether a text holds any of the terms, in any case; no terms match all."""
    return F.size(word_hits(F.lower(text), [t.lower() for t in terms])) > 0 if terms else F.lit(True)


def is_marketing(text: Column, negative: Sequence[str], rescue: Sequence[str]) -> Column:
    """A marketing word is there and no word that excuses it."""
    low = F.lower(text)
    return (F.size(word_hits(low, [w.lower() for w in negative])) > 0) & (F.size(word_hits(low, [w.lower() for w in rescue])) == 0)


def search_page_state(html: Column, keyword: Column, cards: str, blocked: Sequence[str], none: Sequence[str]) -> Column:
    """Why a search page has no results: parser_mismatch, blocked or no_result, by the first rule that holds."""
    page = F.coalesce(html, F.lit(""))
    any_of = lambda words: F.size(word_hits(page, words)) > 0
    token = F.exists(F.filter(F.split(F.coalesce(keyword, F.lit("")), r"\s+"), lambda w: w != ""), lambda w: F.contains(page, w))
    return F.when(F.contains(page, F.lit(cards)), "parser_mismatch").when(any_of(blocked), "blocked").when(any_of(none), "no_result").when(~token, "blocked").otherwise("no_result")


# Names of credentials, by what stands for them where only blanks set the value apart; beginnings of keys.
CREDENTIALS = {"authorization": ("authorization", "bearer"), "credential": ("access token", "api key", "key", "password", "secret", "token")}
KEY_BEGINNINGS = ("ak", "key", "sk")


def redacted(kind: Column, message: Column, most: int = 1024) -> Column:
    """An error's kind and message for a log: credentials replaced, white space collapsed, cut to `most` characters.

    A credential is what follows one of CREDENTIALS (in any case, also as the end of a longer name,
    with any of `_`, `-` and blank between its words), up to white space, a comma, a semicolon or
    an ampersand; the word bearer ahead of it belongs to it. After `:` or `=` the name stays;
    after blanks alone the group's name stands for it. What has the shape of a key goes wherever it is.
    """
    gone, value = "<redacted>", r"(?:bearer\s+)?[^\s,;&]+"
    spelt = {group: "|".join(name.replace(" ", "[_ -]?") for name in names) for group, names in CREDENTIALS.items()}
    rules = [(rf"([\w-]*(?:{'|'.join(spelt.values())}))\s*[:=]\s*{value}", f"$1={gone}")]
    rules += [(rf"\b(?:{names})\s+(?!{gone}){value}", f"{group}={gone}") for group, names in spelt.items()]
    rules.append((rf"\b(?:{'|'.join(KEY_BEGINNINGS)})-[a-z0-9_-]{{8,}}", gone))
    said = clean_text(message)
    for pattern, put in rules:
        said = F.regexp_replace(said, f"(?i){pattern}", put)
    return F.substring(F.concat(F.coalesce(kind, F.lit("Error")), F.lit(": "), F.coalesce(F.nullif(said, F.lit("")), F.lit("<no detail>"))), 1, most)


def cloud_text(*columns: Column) -> Column:
    """The text of a comment for a word cloud: the first of several columns that is not blank."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns), F.lit(""))
