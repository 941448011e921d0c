"""Vector codes, chat formatting and collocations against brute force, with nulls, ties, repeated rows, clashing columns and empty tables."""

import collections
import hashlib
import math
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import chat, collocations, queries, vectors

DATA = "/root/testdata/sf0.001"

# -- vector codes


def nearest(entries, q):
    d = ((entries - q) ** 2).sum(axis=1)
    return int(d.argmin()), int(d.min())


def brute_codes(rows, parts, entries, rounds):
    """{position of a row: (code, error)} and the codebooks, by loops."""
    kept = [(k, i, [math.floor(1024 * x) for x in v]) for k, (i, v, _) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[1] is None, r[1] or 0, r[2]))
    small = [r for r in kept if len(r[2]) == len(kept[0][2]) and all(abs(x) < vectors.LARGEST * 1024 for x in r[2])]
    width = len(small[0][2]) // parts
    cut = {k: [np.array(v[p * width : (p + 1) * width]) for p in range(parts)] for k, _, v in small}
    books = [np.array([cut[k][p] for k, _, _ in small[:entries]]) for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for v in cut.values():
                groups[nearest(books[p], v[p])[0]].append(v[p])
            for e, members in groups.items():
                books[p][e] = [sum(int(m[j]) for m in members) // len(members) for j in range(width)]
    out = {}
    for k, _, _ in kept:
        found = [nearest(books[p], cut[k][p]) for p in range(parts)] if k in cut else None
        out[k] = ([f[0] for f in found], sum(f[1] for f in found)) if found else (None, None)
    return out, books


def vector_rows():
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(0, 0.2, 8) * 16) / 16], int(i) % 3 if i % 5 else None) for i in rng.permutation(60)]
    rows += [rows[0], rows[1], (rows[2][0], rows[3][1], 1), (None, rows[4][1], 0), (None, rows[4][1], None)]
    rows += [(100, None, 0), (101, [None] + [0.0] * 7, 0), (102, [math.nan] * 8, 0), (103, [math.inf] + [0.0] * 7, None), (104, [1.0, 2.0], 2), (105, [1e9] + [0.0] * 7, 2), (106, [], 1)]
    return rows


def test_vector_codes(spark):
    rows = vector_rows()
    table = spark.createDataFrame([(*r, "clash", k) for k, r in enumerate(rows)], "vec_id long, embedding array<double>, label int, code string, error int").repartition(3)
    coded, books = vectors.compress(table, parts=2, entries=8, rounds=3, bits=2)
    want, entries = brute_codes(rows, 2, 8, 3)
    assert all(np.array_equal(a, b) for a, b in zip(entries, books.entries, strict=True))
    sums = collections.Counter()
    for k, (_, error) in want.items():
        sums[rows[k][2]] += error or 0
    key = lambda r: str(r)
    got = [(r["id"], r["label"], r["code"], r["error"], r["label_error"]) for r in coded.collect()]
    assert sorted(got, key=key) == sorted(((rows[k][0], rows[k][2], *want[k], sums[rows[k][2]]) for k in want), key=key)
    back = {(r["id"], tuple(r["code"])): r["vector"] for r in vectors.decode(coded.where("code is not null"), books).collect()}
    for (_, code), v in back.items():
        assert np.allclose(v, np.concatenate([(entries[p][code[p]] + 0.5) / 1024 for p in range(2)]))
    none, empty = vectors.compress(table.limit(0), parts=2)
    assert none.count() == 0 and empty.digest() == hashlib.sha256(b"").hexdigest()


def test_bounds_find_the_nearest_entry():
    rng = np.random.default_rng(5)
    for size, width, reach in ((256, 16, 300), (40, 3, 4), (1, 2, 9), (256, 4, 1 << 27)):
        entries, asked = rng.integers(-reach, reach, (size, width)), rng.integers(-reach, reach, (300, width))
        entries[size // 2] = entries[0]  # a tie
        asked[:20] = entries[0]
        index, far = vectors.Cells(entries).nearest(asked)
        assert [(int(a), int(b)) for a, b in zip(index, far, strict=True)] == [nearest(entries, q) for q in asked]


# -- chats


def brute_chats(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))]
        said = "".join(t for role, t in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(chat.MARKED.render(turns)))
    return out


def chat_rows():
    hostile = queries.HOSTILE
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<turn user>\nno</turn>\n"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, "assistant", "\\"), (3, 0, None, "x"), (3, 1, "a>b\\", hostile)]
    rows += [(4, k, ("user", "assistant")[k % 2], f"turn {k} {'é😀' * (k % 7)} {hostile}") for k in range(300)]
    rows += [(5, 0, "assistant", "twice"), (5, 0, "assistant", "twice"), (None, 0, "assistant", "no id"), (None, None, "user", "no turn"), (6, 0, "user", "long " * 200_000)]
    return rows


def test_chats(spark):
    rows = chat_rows()
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, block string, place int").repartition(5)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # conversation 4 stays dealt over several range partitions
    try:
        formatted = chat.format_chats(table).persist()
        got = {r["conv_id"]: tuple(r)[1:] for r in chat.digests(formatted).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert got == brute_chats(rows)
    blocks = sorted(formatted.where("conv_id = 4").collect(), key=lambda r: r["block"])
    assert [b["first_turn"] for b in blocks] == list(range(0, 300, 32)) and not any(b["fault"] for b in blocks)
    assert chat.MARKED.parse("".join(b["text"] for b in blocks)) == [(r[2], r[3]) for r in rows if r[0] == 4]
    for b in blocks:
        assert [s["start"] for s in b["spans"]] == [0, *(s["stop"] for s in b["spans"])][:-1] and b["spans"][-1]["stop"] == len(b["text"])
    assert chat.digests(chat.format_chats(table.limit(0))).count() == 0


@given(st.lists(st.tuples(st.text(), st.text(alphabet="\\<>/turn \nab") | st.sampled_from([queries.HOSTILE, "</turn>", "\\", "<turn x>\n"]))))
def test_marked_text_reads_back(turns):
    assert chat.MARKED.parse(chat.MARKED.render(turns)) == turns


def test_templates_that_rewrite_history_are_found(spark):
    def forgets(turns):  # thoughts of earlier turns go once a user speaks again
        last = max((k for k, (role, _) in enumerate(turns) if role == "user"), default=0)
        return "".join(f"[{role}]{re.sub('<think>.*?</think>', '', text) if k < last else text}" for k, (role, text) in enumerate(turns))

    turns = [("user", "a"), ("assistant", "<think>hm</think>b"), ("user", "c"), ("assistant", "<think>so</think>d")]
    text, spans, fault = chat.spans(forgets, turns)
    assert "turn 2 rewrites" in fault and text == forgets(turns)
    under_loss = [text[s[3] : s[4]] for s in spans if s[5]]
    assert under_loss == ["<think>so</think>d"]  # the first answer stands there no more
    closed = lambda turns: "".join(f"[{r}]{t}" for r, t in turns) + "END"
    assert "rewrites" in chat.spans(closed, turns)[2]
    numbered = lambda turns: "".join(f"{k}[{r}]{t}" for k, (r, t) in enumerate(turns))
    assert chat.spans(numbered, turns)[2] is None and "turns back" in chat.spans(numbered, turns[2:], turns[:2])[2]
    trimmed = lambda turns: "".join(f"[{r}]{t.strip()};" for r, t in turns)
    text, spans, fault = chat.spans(trimmed, [("user", " a "), ("assistant", " b ")])
    assert fault is None and text[spans[1][3] : spans[1][4]] == "b"
    table = spark.createDataFrame([(1, k, *t) for k, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    bad = chat.format_chats(table, chat.Template(forgets, str, lambda text: []))
    assert "rewrites" in bad.first()["fault"]
    with pytest.raises(Exception, match="rewrites"):
        chat.digests(bad).collect()


# -- collocations


def brute_phrases(rows, least, most_words, taken, kept):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most_words + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    by = collections.defaultdict(list)
    for (lang, words), a in candidates.items():
        if any(len(w) > len(words) and m == lang and 100 * b >= taken * a and any(w[i : i + len(words)] == words for i in range(len(w))) for (m, w), b in candidates.items()):
            continue
        cuts = [(math.floor(Fraction(1000000 * a * a, f[lang, words[:k]] * f[lang, words[k:]])), k) for k in range(1, len(words))]
        score, k = min(cuts)
        by[lang].append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in by.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:kept]))


def phrase_rows():
    rng = np.random.default_rng(7)
    words = np.array(["New", "york", "city", "é", "Ü", "a", "of", "the", "7", "x\u00a0y", "z"])
    marks = np.array([" ", "  ", "\t", ", ", ". ", "\n", "!", " ", " ", " "])
    rows = [("".join(w + m for w, m in zip(rng.choice(words, k), rng.choice(marks, k), strict=True)), rng.choice(["en", "de"])) for k in rng.integers(1, 200, 40).tolist()]
    rows = [(t, str(lang)) for t, lang in rows]
    return [*rows, rows[0], rows[0], ("new york city " * 50, None), ("new york city", "und"), ("", "en"), (None, "fr"), ("...", "en"), ("only once here", "xx"), ("hot pair " * 20_000, "en")]


@pytest.mark.parametrize("size", [{"bits": 12}, {"bits": 24, "most_words": 4, "least": 3, "kept": 7}])
def test_collocations(spark, size, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 3000)
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, phrase string, n int").repartition(4)
    got = sorted(map(tuple, collocations.collocations(docs, **size).collect()))
    assert got == brute_phrases(rows, size.get("least", 10), size.get("most_words", 3), 50, size.get("kept", 2000)) and got
    assert collocations.collocations(docs.limit(0), **size).count() == 0


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits."""
    exact = lambda c: F.col(c).cast("decimal(16,0)")
    rows = [(10**15 + 7, 10**15 + 9, 10**15 + 11), (10**12 + 1, 3 * 10**12 + 1, 10**13)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = df.select(F.call_function("div", exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)"), exact("l") * exact("r")).alias("s")).collect()
    assert [r["s"] for r in got] == [1000000 * a * a // (x * y) for a, x, y in rows]


def test_new_queries_match_their_sql(spark):
    duck = duckdb.connect()
    for name in ("documents", "embeddings", "conversations"):
        duck.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, DATA)
        columns = sorted(df.columns)
        found = duck.execute(sql)
        at = [[d[0] for d in found.description].index(c) for c in columns]
        assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[k] for k in at) for r in found.fetchall()), name
