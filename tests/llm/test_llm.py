"""Small fixtures for each operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, and brute force."""

import hashlib
import html.parser
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearsay.llm import chat, components, decontaminate, fingerprint, html_text, language_model, line_dedup, mixing, near_dup, queries, toxicity, warc
from tests.check import assert_same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({c: c + 32 for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOW))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def documents(spark, rows):
    """Rows of (doc_id, text) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "s", "x", 1) for i, t in rows], "doc_id long, text string, source string, band string, n long")


PASSAGE = " ".join(f"w{i}" for i in range(60))
EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, "One\ttwo"), (6, PASSAGE), (7, PASSAGE), (8, PASSAGE + " tail"), (9, "x " * 30_000), (None, PASSAGE), (10, "é" * 5000), (6, PASSAGE)]


@pytest.mark.parametrize("name", ["op1_mix", "op2_chat", "op5_minhash", "op8_revisits", "op9_line_dedup"])
def test_same_rows_as_sql(spark, sf, duck, name):
    assert_same(queries.QUERIES[name](spark, sf), duck.sql(queries.ORACLE_SQL[name]))


def test_near_duplicates_edges(spark):
    out = near_dup.near_duplicates(documents(spark, EDGE)).collect()
    assert len(out) == len(EDGE)
    got = {r.doc_id: r for r in out if r.doc_id is not None}
    assert got[5].component_id == 4 and not got[5].kept
    assert [got[i].component_id for i in (6, 7, 8)] == [6, 6, 6]
    assert [got[i].n_shingles for i in (1, 2, 3)] == [0, 0, 0] and all(got[i].kept for i in (1, 2, 3))
    assert near_dup.near_duplicates(documents(spark, [])).count() == 0
    kept = near_dup.drop_near_duplicates(documents(spark, EDGE))
    assert kept.columns == ["doc_id", "text", "source", "band", "n"]


def test_near_duplicates_by_brute_force(spark):
    base = [f"t{i}" for i in range(40)]
    rows = [(k, " ".join(base[:k] + ["new"] * (k % 3) + base[k:])) for k in range(25)] + [(100 + k, " ".join(base[k:] + ["z"] * k)) for k in range(8)]
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(documents(spark, rows)).collect()}
    assert got == {i: find(i) for i in sets}


def family(n, own, length=120, members=1):
    """n texts of one template, each with its own words in a share of places; and near copies of some."""
    rng = np.random.default_rng(n)
    out = []
    for i in range(n):
        w = [f"t{k}" for k in range(length)]
        for k in rng.choice(length // 6, size=int(own * length / 6), replace=False):
            w[k * 6] = f"own{i}x{k}"
        out.append(" ".join(w))
        out += [" ".join([*w[:-1], f"copy{i}"])] * (members - 1)
    return out


def test_near_duplicates_of_a_crowd(spark):
    """A family of texts that are alike but not linked, near copies in it, and two large groups under the threshold: exact, by rare shingles."""
    texts = family(150, 0.45) + family(90, 0.35, 130, 2)
    rows = list(enumerate(texts))
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = {i: find(i) for i in sets}
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(documents(spark, rows)).collect()}
    assert got == want and len(set(want.values())) > 150
    # the pairs that rare shingles choose hold all links between different components, whatever these are
    node = spark.createDataFrame([(i, len(sets[i]), i) for i, _ in rows], "doc_id long, n long, c long")
    pairs = {(r.a, r.b) for r in near_dup.rare_pairs(node, documents(spark, rows).select("doc_id", "text"), 5, 75).collect()}
    links = {(j, i) for i in sets for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert links <= pairs and len(pairs) < len(rows) ** 2 / 8


def test_components(spark):
    """A hub, a long path, loops, nulls and repeated edges."""
    hub = [(7, k) for k in range(100, 2100)]
    path = [(k, k + 1) for k in range(5000, 5060)]
    edges = spark.createDataFrame(hub + path + [(3, 3), (None, 4), (5, None), (7, 100), (100, 7), (2100, 2099)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {7: 7} | {k: 7 for k in range(100, 2101) if k < 2100} | {2100: 7} | {k: 5000 for k in range(5000, 5061)}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_drop_near_duplicates_with_clashing_names(spark):
    table = spark.createDataFrame([(1, PASSAGE, 1, 2), (2, PASSAGE, 1, 2), (3, "other", 1, 2), (None, PASSAGE, 1, 2)], "doc_id long, text string, gone long, _gone long")
    kept = near_dup.drop_near_duplicates(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {1, 3, None}


def test_contamination_by_brute_force(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.contamination(docs, items).collect()}
    want = {}
    bench = {r.item_id: words(r.text) for r in items.collect()}
    for d in docs.collect():
        w = words(d.text)
        for i, it in bench.items():
            n, c = len(it), Counter(tuple(it[k : k + 5]) for k in range(max(len(it) - 4, 1)))
            if not set(c) & {tuple(w[k : k + 5]) for k in range(len(w))}:
                continue
            best = 0
            for s in range(max(len(w) - n, 0) + 1):
                x = w[s : s + n]
                e = Counter(tuple(x[k : k + 5]) for k in range(max(len(x) - 4, 1)))
                shared = sum((c & e).values())
                best = max(best, shared / (sum(c.values()) + sum(e.values()) - shared))
            if best >= 0.75:
                want[d.doc_id, i] = round(best, 9)
    assert got == want and want


def changed(rng, item, edits, kind):
    """item with some of its words replaced, left out or new ones put between."""
    out = list(item)
    for j in rng.choice(len(item), size=edits, replace=False):
        if kind == "replaced":
            out[j] = f"new{j}"
        elif kind == "deleted":
            out[j] = ""
        else:
            out[j] += f" new{j}"
    return [w for w in " ".join(out).split() if w]


def most_like(text, item):
    """Greatest weighted similarity of an item with a stretch of text of its size."""
    c, best = Counter(tuple(item[k : k + 5]) for k in range(len(item) - 4)), 0
    for s in range(max(len(text) - len(item), 0) + 1):
        x = text[s : s + len(item)]
        e = Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4))
        shared = sum((c & e).values())
        best = max(best, shared / (sum(c.values()) + sum(e.values()) - shared))
    return best


def test_contamination_recall_of_edited_passages(spark):
    """Items of 14 to 500 words with words replaced, deleted and inserted, down to just over 0.75, in texts and alone."""
    rng = np.random.default_rng(5)
    vocabulary, share = [f"v{i}" for i in range(3000)], 1 / np.arange(1, 3001)

    def prose(n):
        return [vocabulary[i] for i in rng.choice(3000, size=n, p=share / share.sum())]

    items, docs, want = [], [], set()
    for i in range(180):
        item = prose((14, 20, 35, 60, 120, 300, 500)[i % 7])
        items.append((i, " ".join(item)))
        for kind in ("replaced", "deleted", "inserted"):
            for edits in range(max(1, len(item) // 40), 0, -1):
                part = changed(rng, item, edits, kind)
                text = part if i % 3 == 0 else prose(150) + part + prose(90)
                if most_like(text, item) >= 0.75:
                    break
            else:
                continue
            want.add((len(docs), i))
            docs.append((len(docs), " ".join(text)))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    # ids of a narrow type stay what they are
    found = decontaminate.contamination(table, spark.createDataFrame(items, "item_id int, text string"))
    assert found.schema["item_id"].dataType.simpleString() == "int"
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    print("recall of edited passages", len(want & got), "of", len(want))
    assert len(want) > 300 and len(want & got) >= 0.995 * len(want)


def test_contamination_edges(spark):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (None, "one two"), (4, "never seen here")], "item_id long, text string")
    rows = decontaminate.contamination(documents(spark, EDGE), items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(4, None), (5, None), (6, 1), (7, 1), (8, 1), (None, 1)}
    clean = decontaminate.decontaminate(documents(spark, EDGE), items)
    assert {r.doc_id for r in clean.collect()} == {1, 2, 3, 9, 10} and "band" in clean.columns
    assert decontaminate.contamination(documents(spark, EDGE), items.limit(0)).count() == 0
    assert decontaminate.decontaminate(documents(spark, []), items).count() == 0


def test_lines(spark):
    block = "a b\nc d\ne f"
    rows = [(1, f"{block}\nfirst"), (2, f"x\n{block}\ng\n"), (3, "\n\n\n\n"), (4, "\n\n\n\n"), (5, None), (6, "two\nlines"), (7, "q\nq\nq\nq\nr"), (2, f"x\n{block}\ng\n"), (None, f" a b\t\nc d \n e f\nz")]
    out = line_dedup.drop_repeated_lines(documents(spark, rows), counts=("a", "b")).collect()
    got = {r.doc_id: (r.text, r.a, r.b) for r in out}
    assert len(out) == len(rows)
    assert got[1] == (f"{block}\nfirst", 4, 0) and got[2] == ("x\ng\n", 6, 3)
    assert got[3][0] == got[4][0] == "\n\n\n\n" and got[5] == (None, 1, 0) and got[6][2] == 0
    assert got[7] == ("q\nr", 5, 3) and got[None] == ("z", 4, 3)
    assert line_dedup.drop_repeated_lines(documents(spark, [])).count() == 0


def test_lines_of_passages_within_lines(spark):
    """Passages of over 50 words that stand on one line, begin and end within lines, or are laid out otherwise."""
    one = "Here it begins and goes on for some words, then it turns a corner. " + " ".join(f"word{i}" + "," * (i % 9 == 8) for i in range(40)) + ". It closes with a sentence that all share."
    rows = [(1, f"Some text of its own. {one}\nmore"), (2, f"Other words, all new. {one} And an end."), (3, f"a\n{one}\nb"), (4, f"{one}\n{one}"), (5, "Nothing, of this. Is here, at all, and it goes on for long, with no repeat"), (6, f"x\x1ey. {one} q\x1er"), (7, PASSAGE), (8, f"a\n{PASSAGE}\nb")]
    out = {r.doc_id: (r.text, r.a, r.b) for r in line_dedup.drop_repeated_lines(documents(spark, rows), counts=("a", "b")).collect()}
    assert out[1][0] == rows[0][1] and out[1][2] == 0 and out[5][0] == rows[4][1]
    assert out[2][0] == "Other words, all new. And an end." and out[3][0] == "a\nb" and out[4][0] == ""
    assert out[6][0] == "x\x1ey. q\x1er"
    # without marks, one line is no window
    assert [out[i][0] for i in (7, 8)] == [PASSAGE, f"a\n{PASSAGE}\nb"]


def test_lines_edges(spark):
    """Long texts, wide marks, clashing names, ids of rows with different texts."""
    wide = "\u8fd9\u662f\u4e00\u6bb5\u6587\u5b57\uff0c" * 3 + "\u5b83\u5f88\u957f\u5f88\u957f\u5f88\u957f\u3002" * 9
    long = "\n".join(f"line {i}" for i in range(30_000))
    table = spark.createDataFrame([(1, wide, 1, 2), (2, f"\u7532{wide}", 1, 2), (3, long, 1, 2), (4, f"{long}\nlast", 1, 2), (4, "short", 1, 2), (None, None, 1, 2)], "doc_id long, text string, gone long, _gone long")
    out = line_dedup.drop_repeated_lines(table)
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert out.columns == table.columns and len(got) == 6
    assert {(3, long), (4, "last"), (4, "short"), (None, None)} <= got
    assert [t for i, t in got if i == 2][0].startswith("\u7532") and len([t for i, t in got if i == 2][0]) < 10


def test_lines_are_cut_once(spark, sf):
    """No filter that Spark adds marks and splits the texts a second time."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = line_dedup.line_windows(docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"), "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    counted = line_dedup.drop_repeated_lines(documents(spark, [(1, ""), (2, "a. "), (3, "a. \nb"), (4, "\u3002\uff0cx\n\ny\uff01")]), counts=("a", "b")).collect()
    assert {r.doc_id: (r.a, r.b) for r in counted} == {1: (1, 0), 2: (1, 0), 3: (2, 0), 4: (5, 0)}


def test_mixing(spark):
    rows = [(i, "w " * (i % 7 * 50), None if i % 5 == 4 else f"s{i % 5}") for i in range(60)] + [(7, None, "s0"), (None, "a b c", "s1"), (3, "w " * 150, "s3"), (99, "solo", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rank", F.lit(1))
    mix = mixing.mix_sources(docs, block=8, slots=64)
    out = mix.taken().collect()
    assert len(out) == len(rows) and all(r.taken <= 3 * r.size for r in out)
    taken, target = Counter(), {}
    for r in out:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert abs(sum(target.values()) - sum(r.size for r in out)) < 1e-6
    assert all(abs(taken[s] - t) <= 16 for s, t in target.items())
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_sources(docs.repartition(7), block=8, slots=64).taken().collect()))
    laid = mix.layout().agg(F.sum("words")).first()[0]
    assert laid == sum(taken.values())
    assert mixing.mix_sources(docs.limit(0)).taken().count() == 0 and mixing.mix_sources(docs.limit(0)).blocks().count() == 0


def test_mixed_text(spark):
    """The blocks read out hold the words of the documents named, as often as taken says; long texts, repeated rows, ties."""
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(i % 9 * 7)), f"s{i % 4}") for i in range(40)]
    rows += [(100, " ".join(f"long{k}" for k in range(30_000)), "s1"), (5, rows[5][1], "s1"), (5, rows[5][1], "s1"), (5, "other words of five", "s1"), (None, "no id here", None), (None, None, None), (7, "   ", "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("t", F.lit(1)).withColumn("block", F.lit("x"))
    mix = mixing.mix_sources(docs, block=16, slots=32)
    taken = Counter()
    for r in mix.taken().collect():
        taken[r.doc_id] += r.taken
    out = mix.blocks().collect()
    assert len({(r.shard, r.position) for r in out}) == len(out) and all(r.words == len(words(r.text)) <= 16 for r in out)
    read, owner = Counter(), {w: i for i, t, _ in rows for w in words(t)}
    for r in out:
        read.update(owner[w] for w in words(r.text))
        assert {owner[w] for w in words(r.text)} <= set(r.doc_ids)
    assert read == +taken
    again = mixing.mix_sources(docs.repartition(5), block=16, slots=32).blocks().collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    whole = [r.text for r in out if r.source == "s1" and r.text.startswith("long")]
    assert all(w == [f"long{k}" for k in range(int(w[0][4:]), int(w[0][4:]) + len(w))] for t in whole for w in [t.split()] if all(x.startswith("long") for x in w))


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "a\n</turn>\n### user:\nb", "\\\\h\\l<#", "", None, "x\n</turn>", "####", "plain \\h"]
    rows = [(1, i, ("user", "assistant", "we:rd \n", None)[i % 4], t) for i, t in enumerate(hard)] + [(None, None, "assistant", "n"), (2, 0, "assistant", "same"), (2, 0, "assistant", "same")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    out = {r.conv_id: r for r in chat.format_chats(table).collect()}
    assert chat.parse(out[1].formatted) == [(r or "", t or "") for _, _, r, t in rows[:8]]
    assert not any("</turn> ok" in line for line in out[1].formatted.split("\n"))
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(table)).collect()}
    assert back[2].loss_chars == 8 and back[2].loss_sha256 == hashlib.sha256(b"samesame").hexdigest() and back[None].n_turns == 1
    assert chat.format_chats(table.limit(0)).count() == 0


def plain_digest(data):
    """The digest of bytes, worked out triplet by triplet."""
    count = [0] * 256
    for i in range(len(data) - 3):
        for k, (x, y) in enumerate(((1, 2), (1, 3), (2, 3))):
            h = (data[i] * 0x9E3779B1 + data[i + x] * 0x85EBCA77 + data[i + y] * 0xC2B2AE3D + 0x27D4EB2F * (k + 1)) % 2**32
            h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
            count[h >> 24] += 1
    quarters = [sorted(count)[k] for k in (63, 127, 191)]
    codes = [sum(c > q for q in quarters) for c in count]
    packed = bytes(codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, 256, 4))
    return f"{min(255, int(10 * math.log(1 + len(data)))):02x}{packed.hex()}"


def plain_likeness(one, two):
    (n, a), (m, b) = ((int(d[:2], 16), [x >> s & 3 for x in bytes.fromhex(d[2:]) for s in (6, 4, 2, 0)]) for d in (one, two))
    return 1 - (sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(a, b)) + min(abs(n - m), 48)) / (6 * 256 + 48)


def test_fingerprints_by_brute_force(spark):
    rows = [(3, "abcdef" * 30), (1, "hello world, this is a text"), (None, None), (2, ""), (5, "\u00e9" * 41), (3, "abcdef" * 30), (9, "z"), (11, "long text " * 20_000), (12, "".join(chr(97 + i * i % 26) for i in range(3000)))]
    out = fingerprint.edit_likeness(documents(spark, rows)).collect()
    order = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    want = []
    for k, (some, i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        changed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = (plain_digest(x.encode()) for x in (t, changed, after))
        want.append((i if some else None, len(t), hashlib.sha256(changed.encode()).hexdigest(), a, b, plain_likeness(a, b), plain_likeness(a, c)))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert fingerprint.edit_likeness(documents(spark, [])).count() == 0
    assert fingerprint.edit_likeness(documents(spark, [(4, "only me")])).first().near_next == 1.0


def test_kernel_is_the_gap_weighted_sum():
    def brute(s, t):
        from itertools import combinations

        total = 0
        for i in combinations(range(len(s)), 3):
            for j in combinations(range(len(t)), 3):
                if all(s[a] == t[b] for a, b in zip(i, j)):
                    total += toxicity.DECAY ** (i[2] - i[0] + 1 + j[2] - j[0] + 1)
        return total

    for s, t in (("idxiot", "idiot"), ("banana", "ananas"), ("abc", "xyz")):
        assert abs(float(toxicity.kernel(toxicity.codes([s]), toxicity.codes([t]))[0, 0]) - brute(s, t)) < 1e-5


def test_toxicity(spark, sf):
    clean = ["the weather is fine", "we met a friend", "lunch was good today", "read the manual first"]
    rude = ["you total blockhead", "what a blockhead you are", "blockhead and again", "oh blockhead"]
    rows = [(f"{c} {i}", 0) for i in range(12) for c in clean] + [(f"{c} {i}", 1) for i in range(12) for c in rude]
    train = spark.createDataFrame(rows, "text string, toxic int")
    model = toxicity.fit(train)
    probe = ["such a blockxhead", "b l o c k h e a d", "a lovely lunch", None, "", "x" * 5000]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(probe)], "doc_id long, text string, score double")
    got = {r.doc_id: r.s for r in df.select("doc_id", toxicity.toxicity_score(model, F.col("text")).alias("s")).collect()}
    assert got[0] > 0.7 and got[1] > 0.7 and max(got[2], got[3], got[4], got[5]) < 0.5
    assert toxicity.drop_toxic(df, model).count() == 4
    none = toxicity.fit(train.where("toxic = 0"))
    assert 0 <= df.select(toxicity.toxicity_score(none, F.col("text"))).first()[0] < 0.1
    assert toxicity.fit(train.limit(0)).landmarks == []


def test_html():
    show = html_text.visible_text
    assert show("<p>a<p>b<br>c<div hidden>x</div><script>if (a<b) '</p>'</script>") == "a\n\nb\nc"
    assert show("<ul><li>x<li>y<ol><li>1<li>2</ol></ul>z") == "- x\n- y\n  1. 1\n  2. 2\n\nz"
    assert show("<table><tr><th>A<th>Bee<tr><td>long cell<td>2</table>") == "A          Bee\nlong cell  2"
    assert show(None) == show("") == show("<style>p{}") == ""
    assert show("a &lt; b < c <b>bold") == "a < b < c bold"
    assert show("<pre>\n a\n  b</pre>") == " a\n  b"
    assert show('<p style="display: none">no</p><p hidden>no</p>yes') == "yes"
    assert len(show("<div>" * 20_000 + "deep")) == 4 and show("<table><tr><td>" * 300 + "in") == "in"


class PlainText(html.parser.HTMLParser):
    """The words of a page that show, by Python's own parser: no layout, but the same visibility."""

    void = set("area base br col embed hr img input link meta param source track wbr".split())
    unseen = set("head script style template noscript title iframe object svg math canvas audio video datalist select option".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.words = [], []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "img" and not any(h for _, h in self.open):
            self.words += (attrs.get("alt") or "").split()
        if tag not in self.void:
            style = (attrs.get("style") or "").replace(" ", "").lower()
            hidden = tag in self.unseen or "hidden" in attrs or "display:none" in style or "visibility:hidden" in style
            if tag == "body":
                self.open = [x for x in self.open if x[0] != "head"]
            self.open.append((tag, hidden))

    def handle_endtag(self, tag):
        at = max((i for i, (t, _) in enumerate(self.open) if t == tag), default=None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        if not any(h for _, h in self.open):
            self.words += data.split()


def test_html_words_by_another_parser(spark, sf):
    """Every visible word of every page, and no other, whatever the layout; the marks of lists aside."""
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r.text for r in html_text.extract_text(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    assert len(got) == len(rows) > 20
    for r in rows:
        parser = PlainText()
        parser.feed(r.html or "")
        parser.close()
        text = re.sub(r"(?m)^ *(?:-|\d+\.) ", "", got[r.page_id])
        want, own = Counter("".join(parser.words)), Counter("".join(text.split()))
        assert sum((want - own).values()) <= 6 and sum((own - want).values()) <= 6, r.page_id


def test_html_tables_by_brute_force():
    """Random grids with cells of several lines and spans: each cell stands at its column's place, all cells are there."""
    rng = np.random.default_rng(1)
    for _ in range(60):
        height, wide = rng.integers(1, 5), rng.integers(1, 5)
        grid = [[["x" * int(rng.integers(1, 8)) for _ in range(rng.integers(1, 3))] for _ in range(wide)] for _ in range(height)]
        source = "<table>" + "".join("<tr>" + "".join(f"<td>{'<br>'.join(c)}</td>" for c in row) + "</tr>" for row in grid) + "</table>"
        width = [max(len(line) for row in grid for line in row[k]) for k in range(wide)]
        want = []
        for row in grid:
            for k in range(max(map(len, row))):
                want.append("  ".join((c[k] if k < len(c) else "").ljust(w) for c, w in zip(row, width)).rstrip())
        assert html_text.visible_text(source) == "\n".join(want)
    show = html_text.visible_text
    assert show("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>") == "a  b\n   c\nd  e"
    assert show("<table><tr><td colspan=1000>wide<td>z<tr><td>a<td>b</table>").split("\n")[1] == "a  b"
    assert show("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>") == "a  b\n   c\n   d"
    deep = show("<table><tr><td>k<td>" * 400 + "in")
    assert deep == "k  " * 400 + "in"
    assert show("<p aria-hidden=true>seen</p><textarea>a &lt;b\n c</textarea>") == "seen\n\na <b\n c"
    assert len(show("<table>" + "<tr><td>x<td>" + "y " * 200_000 + "</table>")) > 400_000


def test_html_head_without_its_end():
    show = html_text.visible_text
    for first in ("<body><p>text", "<p>text", "<div>text</div>", "text", "<br>text", "</body>text"):
        assert show(f"<html><head><title>t</title><meta charset=u><script>x</script>{first}") == "text"
    assert show("<head><noscript><link href=x></noscript><p>text") == show("<head><noscript><img></noscript><p>text") == "text"
    assert show("<head><template><p>no</p></template><title>t</title></head><p>yes") == "yes"


def test_html_table_edges(spark):
    pages = spark.createDataFrame([(1, "<p>a", "t"), (None, None, "t"), (1, "<p>a", "t")], "page_id long, html string, text string")
    assert sorted(map(str, html_text.extract_text(pages).collect())) == sorted(["Row(page_id=1, text='a')"] * 2 + ["Row(page_id=None, text='')"])
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_revisits(spark):
    schema = "record_id long, url string, ts long, type string, status int, headers map<string,string>, payload string"
    page = "http://www.Example.com:80/a/?b=2&utm_x=1&a=1#f"
    rows = [
        (1, page, 10, "response", 200, {"ETag": '"1"', "Content-Type": "t", "Date": "d1"}, "one"),
        (2, "https://example.com/a?a=1&b=2", 20, "response", 200, {"ETag": '"2"', "X": "y"}, "two"),
        (3, page, 15, "revisit", 304, {"etag": 'W/"1"', "Date": "d2", "Content-Type": "no"}, None),
        (4, page, 25, "revisit", 304, {"ETag": '"1"'}, None),
        (5, page, 5, "revisit", 304, {"ETag": '"1"'}, None),
        (6, None, 30, "revisit", 304, None, None),
        (7, page, None, "revisit", 304, {"ETag": '"2"', "etag": '"3"'}, None),
        (8, page, 20, "revisit", 304, {"ETag": '"2"'}, None),
        (9, page, 22, "response", 500, {"ETag": '"9"'}, "err"),
    ]
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, schema).withColumn("verdict", F.lit(0))).collect()}
    assert {k: (r.verdict, r.response_id) for k, r in got.items()} == {3: ("resolved", 1), 4: ("validators differ", None), 5: ("no response", None), 6: ("no response", None), 7: ("no response", None), 8: ("resolved", 2)}
    assert got[3].headers == {"content-type": "t", "etag": 'W/"1"', "date": "d2"} and got[3].payload == "one"
    assert warc.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_revisits_repeated_rows_and_long_payloads(spark):
    schema = "record_id long, url string, ts long, type string, status int, headers map<string,string>, payload string"
    rows = [(1, "http://a/x", 1, "response", 200, {"etag": "1"}, "p" * 300_000), (2, "http://a/x", 2, "revisit", 304, {"etag": "1"}, None)] + [(10 + k, f"http://none/{k}", 3, "revisit", 304, {}, None) for k in range(50)]
    table = spark.createDataFrame([*rows, rows[1]], schema).withColumns({"met": F.lit(0), "found_id": F.lit(1), "stored": F.lit("x")})
    out = warc.resolve_revisits(table).collect()
    # record_id is a key: both of the equal rows are answered, each by every match of the key
    assert {r.record_id for r in out} == {2, *range(10, 60)} and all(len(r.payload) == 300_000 for r in out if r.record_id == 2)
    assert all(r.verdict == "no response" and r.response_id is None and r.payload is None for r in out if r.record_id >= 10)


def test_chat_of_very_long_texts(spark):
    text = "a line with ### and </turn> in it\n" * 30_000
    table = spark.createDataFrame([(1, k, ("user", "assistant")[k % 2], text) for k in range(4)] + [(None, 0, "assistant", text)], "conv_id long, turn int, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(table)).collect()}
    assert back[1].loss_chars == 2 * len(text) and back[1].n_turns == 4 and back[None].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_language_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "never zzz seen"), (-3, "never zzz seen")], "doc_id long, text string")
    docs = docs.union(extra).withColumn("held_out", F.expr("crc32(cast(doc_id as string)) % 7 = 2 or doc_id < 0"))
    model, counts = language_model.fit(docs.where("not held_out"))
    got = language_model.score(docs, model, counts).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    c = Counter(w for r in rows if not r.held_out for w in [*words(r.text), None])
    n, v = sum(c.values()), len(c)
    text = {r.doc_id: [*words(r.text), None] for r in rows}
    for r in got:
        assert r.train_tokens == n and r.n_tokens == len(text[r.doc_id]) and r.n_known == sum(w in c for w in text[r.doc_id])
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in text[r.doc_id])) < 1e-6 * n
    held = [r for r in got if r.held_out and r.doc_id >= 0]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_predicts_words_by_their_history(spark):
    common = [f"{a}{b}xq" for a in "bcdfghjklm" for b in "aeiou"]
    phrase = [f"rare{k}xq" for k in range(10)]  # none is a class of its own, and all share one by their ending
    docs = [(i, " ".join([*common, *phrase, *common[i % 50 :], *common]), False) for i in range(400)]
    docs += [(1000, " ".join(phrase), True), (1001, " ".join(reversed(phrase)), True), (1002, "unseenxq " * 3, True)]
    table = spark.createDataFrame(docs, "doc_id long, text string, held_out boolean")
    model, counts = language_model.fit(table.where("not held_out"))
    got = {r.doc_id: r for r in language_model.score(table, model, counts).collect()}
    assert len(got) == len(docs) and got[1000].base_score == pytest.approx(got[1001].base_score)
    assert got[1000].score > got[1001].score + 5 and got[1002].n_known == 1


def test_word_endings_do_not_depend_on_other_texts():
    alone, beside = language_model.tokens(pa.array(["plain words"])), language_model.tokens(pa.array(["plain words", "caf\u00e9"]))
    assert alone[1].tolist() == beside[1][:3].tolist() and beside[1][3] & np.uint64(1)


def test_language_model_score_by_a_plain_model(spark):
    """Counts, leaves and the product of softmaxes along a path, worked out word by word; probabilities of all words add up to one at most."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.4, 60) % 300), i % 5 == 4) for i in range(60)] + [(60, None, False), (61, "", True), (62, "w1 unseen w2", True), (62, "w1 unseen w2", True)]
    table = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").withColumn("chunk", F.lit(1))
    model, counts = language_model.fit(table.where("not held_out"))
    again, _ = language_model.fit(table.where("not held_out").repartition(7))
    assert (model.weights == again.weights).all() and np.abs(model.weights).max() > 0.05
    out = language_model.score(table, model, counts).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and len({r.score for r in out if r.doc_id == 62}) == 1
    known = Counter(w for _, t, h in rows if not h for w in [*words(t), None])
    column = pa.array([" ".join(w for w in known if w)])
    every, endings, at = language_model.tokens(column)
    assert model.leaf_tokens.sum() == sum(known.values()) and model.leaf_words.sum() == len(known)

    def chance(history, leaf):
        """Probability of a leaf after a history: hashes of features."""
        p = 1.0
        for k in range(model.depth):
            before, y = int(leaf) // 16 ** (model.depth - k), int(leaf) // 16 ** (model.depth - 1 - k) % 16
            z = np.array(model.bias[k][before], float)
            for f in range(language_model.FEATURES):
                h = (int(history[f]) ^ (before + (k << 32)) * 0x9E3779B97F4A7C15 % 2**64) * 0xD6E8FEB86659FD93 % 2**64
                z += model.weights[k, f, h >> (64 - model.row_bits)]
            p *= math.exp(z[y]) / sum(map(math.exp, z))
        return p

    for i in (0, 4, 61, 62):
        text = next(t for k, t, _ in rows if k == i)
        word, ending, by_row = language_model.tokens(pa.array([text]))
        history, leaf = model.histories(word, ending, by_row), model.leaves(word, ending)
        want = 0.0
        for k, w in enumerate([*words(text), None]):
            want += math.log10(chance(history[:, k], leaf[k])) + math.log10((known[w] + 1) / (model.leaf_tokens[leaf[k]] + model.leaf_words[leaf[k]] + 1))
        assert got[i].score == pytest.approx(want, abs=1e-4)
    one = history[:, :1].repeat(len(every), axis=1)
    leaf = model.leaves(every, endings)
    count = np.array([known[w] for w in [*words(column[0].as_py()), None]])
    assert 0.5 < (10 ** (model.log_paths(leaf, one) + model.log_shares(leaf, count))).sum() <= 1


def test_language_model_held_out_gain(spark):
    out = queries.op10_language_model(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    print("held-out gain in log10 a token", (out[0] - out[1]) / out[2])
    assert (out[0] - out[1]) / out[2] > 0.25


def test_language_model_edges(spark):
    """Empty tables, no training rows, long texts."""
    table = spark.createDataFrame([(1, "x " * 50_000, True), (2, "\u00e9" * 5000, True), (3, None, None)], "doc_id long, text string, held_out boolean")
    model, counts = language_model.fit(table.limit(0))
    got = {r.doc_id: r for r in language_model.score(table, model, counts).collect()}
    assert got[1].n_tokens == 50_001 and got[1].n_known == got[1].train_tokens == 0 and np.isfinite(got[1].score) and got[3].n_tokens == 1
    assert language_model.score(table.limit(0), model, counts).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near duplicates", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = queries.toxicity_model(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.toxicity_score(model, F.col("text")).alias("s")).collect()}
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and all(score[i] < toxicity.THRESHOLD for r in out for i in r.doc_ids) and all(0 < r.words == len(words(r.text)) <= 128 for r in out)


def test_pipeline_edges(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, ties, clashing names, and an empty table, through all stages."""
    import corpus_pipeline

    own = [f"Text number {i} speaks of things{i} and more{i}, then of others{i * 7}. " + " ".join(f"w{i * k % 97}" for k in range(40)) for i in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(own)]
    rows += [(0, own[0], "en", "s0", 1), (40, own[1], None, None, None), (41, None, "en", "s0", 0), (42, "", "en", "s1", 0), (None, "a row without an id", None, "s2", 4), (None, None, None, None, None)]
    labels = [(i, 1, int(i % 6 == 0)) for i in range(20)] + [(None, None, None), (3, 1, None), (3, 1, 0)]
    items = [(1, " ".join(own[4].split()[8:40])), (2, None), (None, "")]
    for name, n in (("full", len(rows)), ("empty", 0)):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows[:n], "doc_id long, text string, lang string, source string, n_chars long").withColumns({"gone": F.lit(1), "h": F.lit("x"), "_label": F.lit(2)}).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels[:n], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame(items[:n], "item_id int, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES[:-1]:
            kept = function(spark, docs, folder)
            assert kept.columns == docs.columns, stage
        out = corpus_pipeline.run(spark, folder).collect()
        if not n:
            assert out == []
        else:
            ids = {i for r in out for i in r.doc_ids}
            assert 4 not in ids and 40 not in ids and not {41, 42} & ids and len(ids) > 10


def test_kernel_sieve_keeps_every_near_match(spark, sf):
    """On real words, the sieve takes nothing from likenesses that count as near, and from others at most what is stated."""
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    seen = sorted({v for t in texts for w in toxicity.units(t or "") if (v := toxicity.unit(w))})[::7]
    seen += [w[:k] + "x" + w[k:] for w in seen[::10] for k in (2, 4)]
    marks = [w for w in seen if 5 <= len(w) <= 12][::97]
    code = toxicity.codes(marks)
    norm = toxicity.kernel(code, code, paired=True)
    full = np.minimum(np.concatenate([toxicity.kernel(toxicity.codes(seen[i : i + 500]), code) for i in range(0, len(seen), 500)]) / norm, 1.25)
    got = toxicity.similarity(seen, code, norm)
    lost = full[got == 0]
    assert np.allclose(got[got > 0], full[got > 0], atol=1e-4) and len(seen) > 1000
    assert lost.max() < 0.75 and np.percentile(lost, 99.9) < 0.4


def test_toxicity_by_a_plain_model(spark):
    """Features, Nyström map, support vector machine and scores against a plain calculation over every word."""
    rude, fine = ["blockhead", "nitwit"], ["weather", "lunch", "manual", "friend", "river"]
    rows = [(f"{fine[i % 5]} {fine[i * 3 % 5]} number{i}", 0) for i in range(30)] + [(f"{fine[i % 5]} {rude[i % 2]} number{i}", 1) for i in range(30)]
    model = toxicity.fit_sample(spark.createDataFrame(rows, "text string, label int"))
    marks = toxicity.codes(model.landmarks)
    norm = toxicity.kernel(marks, marks, paired=True)
    x = []
    for t, _ in rows:
        own = [u for w in toxicity.units(t) if (u := toxicity.unit(w))]
        k = toxicity.similarity(own, marks, norm)
        x.append(np.concatenate([k.max(axis=0), np.log1p(np.maximum(k - 0.75, 0).sum(axis=0) * 4)]))
    x, y = np.array(x), np.array([label for _, label in rows], float)
    z = np.hstack([x[:, : len(marks)] @ model.whiten, x[:, len(marks) :], np.ones((len(x), 1))])
    own = toxicity.kernel(marks, marks) / np.sqrt(np.outer(norm, norm))
    assert np.allclose(model.whiten.T @ own @ model.whiten, np.eye(model.whiten.shape[1]), atol=1e-2)
    # the machine's weights are where the gradient of its objective is nought
    w = np.append(model.weight, model.bias)
    sign, cost = np.where(y > 0, 1, -1), len(y) / 2 / np.where(y > 0, y.sum(), len(y) - y.sum())
    gradient = np.append(model.weight, 1e-6 * model.bias) - z.T @ (cost * sign * np.maximum(1 - sign * (z @ w), 0))
    assert np.abs(gradient).max() < 1e-6
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = dict(df.select("doc_id", toxicity.toxicity_score(model, F.col("text"))).collect())
    assert np.allclose([got[i] for i in range(len(rows))], 1 / (1 + np.exp(-(model.slope * (z @ w) + model.shift))), atol=1e-6)


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op6_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("predicted", "toxic", "score").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit >= 0.65 * sum(r.toxic for r in got) and hit >= 0.9 * sum(r.predicted for r in got)
    worse = [sum(g.score > b.score for g in got if g.toxic) for b in got if not b.toxic]
    assert sum(worse) >= 0.85 * len(worse) * sum(r.toxic for r in got)


def test_toxicity_sample(spark):
    text = "said the nitwit"
    docs = spark.createDataFrame([(1, text, 1, "a"), (1, text, 1, "a"), (1, "other", 1, "a"), (2, text, 1, "a"), (3, None, 1, "a"), (4, "", 1, "a"), (None, "x", 1, "a"), (5, "not labelled", 1, "a")], "doc_id long, text string, label int, h string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (4, 0), (5, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels)
    assert sorted(map(tuple, got.collect())) == [("", 0), ("other", 1), (text, 0), (text, 1)]
    assert toxicity.labelled_sample(docs, labels, max_labelled=2).count() == 2
    assert toxicity.labelled_sample(docs.limit(0), labels).count() == toxicity.labelled_sample(docs, labels.limit(0)).count() == 0
    model = toxicity.fit_sample(got)
    again = docs.select("doc_id", toxicity.toxicity_score(model, F.col("text")).alias("s")).collect()
    assert len(again) == 8 and len({r.s for r in again if r.doc_id == 2} | {again[0].s}) == 1
    assert docs.limit(0).select(toxicity.toxicity_score(model, F.col("text"))).count() == 0


def test_toxicity_scores_by_chunks():
    """Scores take the memory of a chunk, not of a batch's features (128 numbers a text), and are those of the features."""
    marks = [f"^word{chr(97 + i // 8)}{chr(97 + i % 8)}" for i in range(64)]
    model = toxicity.Model(marks, np.eye(64), np.linspace(-1, 1, 128), 0.1, 1.0, 0.0)
    batch = pa.array([None, "", *(f"word{chr(97 + i % 8)}{chr(97 + i % 7)} text{i % 3000}" for i in range(39_998))])
    whole = model.score(next(toxicity.features(marks, iter([batch]))))
    tracemalloc.start()
    got = list(model.scores(iter([batch, batch.slice(0, 0), batch.slice(5, 70)])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(x) for x in got] == [40_000, 0, 70] and len(np.unique(whole)) > 20
    assert np.allclose(got[0], whole, atol=1e-9) and np.allclose(got[2], whole[5:75], atol=1e-9)
    # the features alone are 41 MB
    assert most < 25_000_000, most
