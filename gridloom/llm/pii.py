"""Personal data: generated candidates judged by boosted trees, SQL functions only.

High-recall generators propose overlapping spans. The base kinds (email, ip,
card, phone) have fixed patterns and checks and always stay. Further candidates
(tokens that hold digits, values behind an assignment) are looked for in the
text with the base spans blanked, so what a base span leaves of them is still
proposed. They get format and context features; gradient-boosted trees score
them, the scores are calibrated, and a threshold selects. A value may hold
tokens: it stays if it scores as well as each of them, else they stay. The trees
are trained on the driver on a fixed, seeded set of labelled examples made here
(``examples``: there are no labelled spans in the tables) and compiled into CASE
expressions, so the whole operator runs in the JVM: no Python on the executors.

Offsets are code points, ends exclusive. Patterns that run over long texts use
possessive repeats and start at run borders; places are summed by blocks, spans
are sorted once and met in one sweep, so long texts full of spans take time
nearly proportional to their length. Null texts are empty; an empty text has no
spans; repeated rows give a row each; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
#: Patterns of the base kinds: as given, with repeats that need no way back made possessive. A search that
#: starts inside a run of the first class would find nothing that one from the run's start (or from the
#: end of the last match, \G) does not.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{6,}+",
    "value": r"(?<=[=:]|[=:][\x20\"']|[=:]\x20[\"'])[^\s\"'<>=:]{6,}+",
}
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "token": "[0-9]", "value": "[=:]"}
GENERATORS = ("token", "value")
BLOCK = 256
#: Characters before a candidate that its features look at.
CONTEXT = 24
#: Spans up to which a text is cut by positions; texts with more are cut as lists of characters, in one pass.
FEW = 32
THRESHOLD = 0.5
ROUNDS, DEPTH = 24, 3
FEATURES = ("size", "digits", "upper", "lower", "other", "hex", "keyword", "assigned", "prefix", "ssn", "iban", "quoted")


def _barrier(df: DataFrame, **new: Column | str) -> DataFrame:
    """Add columns behind a generator, so that the optimizer cannot copy their expressions into each use."""
    made = F.struct(*((F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in new.items()))
    return df.select("*", F.explode(F.array(made)).alias("_made")).select(*df.columns, "_made.*")


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(df: DataFrame, kinds: tuple[str, ...], text: str = "text", context: bool = False) -> DataFrame:
    """For each kind an array s_kind of (start, stop, value), and with ``context`` before: up to CONTEXT characters, from the match before on."""
    none = lambda kind: f"cast(array() as array<{kind}>)"
    df = _barrier(df, **{f"m_{k}": f"if({text} rlike {_sql(NEEDS[k])}, regexp_extract_all({text}, {_sql(PATTERNS[k])}, 0), {none('string')})" for k in kinds})
    df = _barrier(df, **{f"q_{k}": f"if(size(m_{k}) > 0, split({text}, {_sql(PATTERNS[k])}, -1), {none('string')})" for k in kinds})
    # start of match k: the lengths of all pieces up to it and all matches before it, summed by blocks
    df = _barrier(df, **{f"d_{k}": f"if(size(m_{k}) > 0, transform(sequence(0, size(m_{k}) - 1), i -> length(get(q_{k}, i)) + if(i > 0, length(get(m_{k}, i - 1)), 0)), {none('int')})" for k in kinds})
    df = _barrier(df, **{f"b_{k}": f"if(size(m_{k}) > 0, transform(sequence(0, (size(m_{k}) - 1) div {BLOCK}), b -> aggregate(slice(d_{k}, cast(b as int) * {BLOCK} + 1, {BLOCK}), 0, (a, x) -> a + x)), {none('int')})" for k in kinds})
    df = _barrier(df, **{f"c_{k}": f"transform(b_{k}, (x, i) -> aggregate(slice(b_{k}, 1, i), 0, (a, y) -> a + y))" for k in kinds})
    before = f", lower(right(concat(if(s.i > 0, right(get(m_{{k}}, s.i - 1), {CONTEXT}), ''), get(q_{{k}}, s.i)), {CONTEXT})) as before" if context else ""
    spans = {k: f"transform(transform(m_{k}, (v, i) -> struct(get(c_{k}, i div {BLOCK}) + aggregate(slice(d_{k}, cast(i div {BLOCK} as int) * {BLOCK} + 1, i % {BLOCK} + 1), 0, (a, x) -> a + x) as start, v as value, i as i)), s -> struct(s.start as start, s.start + length(s.value) as stop, s.value as value{before.format(k=k)}))" for k in kinds}
    return _barrier(df, **{f"s_{k}": e for k, e in spans.items()}).drop(*(f"{c}_{k}" for c in "qdbc" + "m" * context for k in kinds))


#: What a match of a base kind must also satisfy.
CHECKS = {
    "email": "true",
    "ip": r"forall(split(s.value, '\\.'), p -> p rlike '^0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$')",
    "card": (
        "length(replace(replace(s.value, ' ', ''), '-', '')) between 13 and 19 and "
        "aggregate(transform(split(reverse(replace(replace(s.value, ' ', ''), '-', '')), ''), (d, i) -> if(i % 2 = 0, coalesce(try_cast(d as int), 0), get(array(0,2,4,6,8,1,3,5,7,9), coalesce(try_cast(d as int), 0)))), 0, (a, x) -> a + x) % 10 = 0"
    ),
    "phone": "length(regexp_replace(s.value, '[^0-9]', '')) between 9 and 15",
}


def _hidden(df: DataFrame) -> DataFrame:
    """Column hidden: the text with the base spans as line breaks, as many as they have characters."""
    df = df.withColumn("hidden", F.col("text"))
    for k in BASE_KINDS:
        pattern, check = _sql(PATTERNS[k]), CHECKS[k].replace("s.value", "get(_m, i)")
        df = _barrier(df, _m=f"if(size(m_{k}) > 0, regexp_extract_all(hidden, {pattern}, 0), cast(array() as array<string>))")
        blank = f"array_join(transform(split(hidden, {pattern}, -1), (p, i) -> concat(p, if(i >= size(_m), '', if({check}, repeat('\n', length(get(_m, i))), get(_m, i))))), '')"
        df = _barrier(df.withColumnRenamed("hidden", "_h"), hidden=f"if(size(_m) > 0, {blank.replace('hidden', '_h')}, _h)").drop("_h", "_m", f"m_{k}")
    return df


def _features(df: DataFrame) -> DataFrame:
    """cands: array of gen's (start, place, stop, value, before) with features."""
    share = lambda cls: f"cast(length(s.value) - length(regexp_replace(s.value, '[{cls}]', '')) as double) / length(s.value)"
    flag = lambda test: f"if({test}, 1D, 0D)"
    made = {
        "size": "cast(length(s.value) as double)",
        "digits": share("0-9"),
        "upper": share("A-Z"),
        "lower": share("a-z"),
        "other": share("^A-Za-z0-9"),
        "hex": flag("s.value rlike '^(?:[0-9a-f]+|[0-9A-F]+)$' and s.value rlike '[a-fA-F]'"),
        "keyword": flag("s.before rlike '(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|bearer|auth)s?[\"\\']?\\\\s*(?:[=:]|is)?\\\\s*[\"\\']?$'"),
        "assigned": flag("s.before rlike '[=:]\\\\s*[\"\\']?$'"),
        "prefix": flag("s.value rlike '^(?:AKIA|ASIA)[A-Z0-9]{12,}$|^(?:gh[pousr]_|sk_|sk-|pk_|xox[abprs]-|glpat-|AIza)[A-Za-z0-9_-]{10,}$'"),
        "ssn": flag("s.value rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$'"),
        "iban": flag("s.value rlike '^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$'"),
        "quoted": flag("s.before rlike '[\"\\']$'"),
    }
    return _barrier(df, cands="transform(gen, s -> struct(s.start as start, s.place as place, s.stop as stop, " + ", ".join(f"{made[n]} as {n}" for n in FEATURES) + "))").drop("gen")


def examples(n: int = 1500, seed: int = 7) -> list[tuple[str, int, int, int]]:
    """Labelled examples (text, start, stop, is personal): made up, the same at every call."""
    rng = random.Random(seed)
    pick = lambda alphabet, a, b: "".join(rng.choice(alphabet) for _ in range(rng.randint(a, b)))
    upper, lower, digits, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    word = lambda: pick(lower, 2, 9)
    key = lambda: rng.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "api-key", "auth token", "access_key"])
    sign = lambda: rng.choice(["=", ": ", " = ", ":", '="', " = \"", ": '"])
    good = [
        lambda: (word() + " ", "AKIA" + pick(upper + digits, 16, 16)),
        lambda: (word() + " ", rng.choice(["ghp_", "sk-", "xoxb-"]) + pick(upper + lower + digits, 20, 40)),
        lambda: (f"{word()} {key()}{sign()}", pick(hexes, 12, 64)),
        lambda: (f"{word()} {key()}{sign()}", pick(upper + lower + digits, 10, 44)),
        lambda: (f"{word()} {key()}{sign()}", word() + pick(digits, 2, 6)),
        lambda: (f"{word()} ssn ", f"{pick(digits, 3, 3)}-{pick(digits, 2, 2)}-{pick(digits, 4, 4)}"),
        lambda: (f"{word()} ", pick(upper, 2, 2) + pick(digits, 2, 2) + pick(digits, 14, 20)),
    ]
    bad = [
        lambda: (word() + " ", word() + pick(digits, 1, 5)),
        lambda: (word() + " ", word() + "-" + pick(digits, 1, 4) + "-" + word()),
        lambda: (word() + " ", f"{pick(digits, 4, 4)}-{pick(digits, 2, 2)}-{pick(digits, 2, 2)}"),
        lambda: (word() + " ", pick(digits, 6, 18)),
        lambda: (word() + rng.choice(["=", ": ", ":"]), word() + pick(digits, 1, 4)),
        lambda: (word() + rng.choice(["=", ": "]), word() + word()),
        lambda: (word() + ": ", pick(digits, 6, 12)),
        lambda: (word() + "/", word() + "/" + pick(digits, 1, 5) + "/" + word()),
        lambda: (word() + " ", pick(upper, 6, 14) + pick(digits, 1, 3)),
        lambda: (word() + " ", pick(digits, 3, 3) + "-" + pick(digits, 4, 4)),
        lambda: (f"{key()} {word()} ", word() + word() + pick(digits, 1, 2)),
        lambda: (word() + " ", pick(hexes, 6, 12) + "1"),
    ]
    out = []
    for i in range(n):
        before, value = rng.choice(good if i % 2 else bad)()
        out.append((f"{word()} {before}{value} {word()}", len(out), len(before) + 1, i % 2))
    rows = []
    for text, _, _, y in out:
        tail = text.rsplit(" ", 1)[0]
        cut = max(tail.rfind(c) for c in " =:\"'") + 1 if y or "/" not in tail else max(tail.rfind(c) for c in " =:") + 1
        rows.append((text, cut, len(tail), y))
    return rows


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple:
    """A regression tree on gradients: ("leaf", value) or (feature, cut, left, right)."""
    best, total = (1e-6, 0, 0.0), g.sum() ** 2 / (h.sum() + 1)
    if depth:
        for k in range(x.shape[1]):
            order = np.argsort(x[:, k], kind="stable")
            cg, ch, xs = np.cumsum(g[order]), np.cumsum(h[order]), x[order, k]
            at = np.flatnonzero(xs[1:] > xs[:-1])
            if len(at):
                gain = cg[at] ** 2 / (ch[at] + 1) + (cg[-1] - cg[at]) ** 2 / (ch[-1] - ch[at] + 1) - total
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], k, float((xs[at[i]] + xs[at[i] + 1]) / 2))
    if best[0] <= 1e-6:
        return ("leaf", float(-g.sum() / (h.sum() + 1)))
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], _tree(x[left], g[left], h[left], depth - 1), _tree(x[~left], g[~left], h[~left], depth - 1))


def _value(tree: tuple, x: np.ndarray) -> np.ndarray:
    if tree[0] == "leaf":
        return np.full(len(x), tree[1])
    return np.where(x[:, tree[0]] <= tree[1], _value(tree[2], x), _value(tree[3], x))


def _case(tree: tuple) -> str:
    if tree[0] == "leaf":
        return f"{tree[1]:.6f}D"
    return f"if(c.{FEATURES[tree[0]]} <= {tree[1]:.6f}D, {_case(tree[2])}, {_case(tree[3])})"


_models: dict[str, str] = {}


def score_sql(spark: SparkSession) -> str:
    """The calibrated probability of candidate c as an SQL expression; trained once a process."""
    if "sql" not in _models:
        rows = examples()
        frame = spark.createDataFrame([(i, t, a, b, y) for i, (t, a, b, y) in enumerate(rows)], "i int, text string, a int, b int, y int")
        frame = frame.coalesce(1).withColumn("gen", F.expr(f"array(struct(a as start, 0 as place, b as stop, substring(text, a + 1, b - a) as value, lower(substring(text, greatest(a - {CONTEXT}, 0) + 1, least(a, {CONTEXT}))) as before))"))
        got = _features(frame).select("i", "y", F.expr("cands[0]").alias("c")).select("i", "y", *(f"c.{n}" for n in FEATURES)).orderBy("i").collect()
        x, y = np.array([[r[n] for n in FEATURES] for r in got], float), np.array([r["y"] for r in got], float)
        aside = np.arange(len(y)) // 2 % 4 == 0
        z, trees = np.zeros(len(y)), []
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-z))
            tree = _tree(x[~aside], (p - y)[~aside], (p * (1 - p))[~aside], DEPTH)
            trees.append(tree)
            z += 0.4 * _value(tree, x)
        from .quality import platt

        a, b = platt(z[aside], y[aside])
        _models["sql"] = f"1D / (1D + exp(-({a:.6f}D * 0.4D * (" + " + ".join(map(_case, trees)) + f") + {b:.6f}D)))"
    return _models["sql"]


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, text, base and found: arrays of (rank, kind, start, stop); found holds base too, ordered by kind, then start."""
    score = score_sql(docs.sparkSession)
    df = docs.select(*keep, *([F.col(id_col)] if id_col not in keep else []), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_whole"))
    df = _found(df.withColumn("text", F.expr("if(_whole rlike '[0-9@=:]', _whole, '')")), BASE_KINDS)
    base = ", ".join(f"transform(filter(s_{k}, s -> {CHECKS[k]}), s -> struct({i} as rank, '{k}' as kind, s.start as start, s.stop as stop))" for i, k in enumerate(BASE_KINDS))
    df = _hidden(_barrier(df, base=f"concat({base})").drop(*(f"s_{k}" for k in BASE_KINDS)))
    df = _found(df, GENERATORS, "hidden", context=True).drop("hidden")
    # place 0: a value, 1: a token; a value comes before the tokens that it holds.
    gen = ", ".join(f"transform(s_{k}, s -> struct(s.start as start, {place} as place, s.stop as stop, s.value as value, s.before as before))" for k, place in (("value", 0), ("token", 1)))
    df = _features(_barrier(df, gen=f"concat({gen})").drop(*(f"s_{k}" for k in GENERATORS)))
    kind = "if(c.prefix = 1D, 'key', if(c.ssn = 1D, 'ssn', if(c.iban = 1D, 'iban', 'secret')))"
    df = _barrier(df, scored=f"array_sort(filter(transform(cands, c -> struct(c.start as start, c.place as place, c.stop as stop, {score} as score, {kind} as kind)), c -> c.score >= {threshold}D))").drop("cands")
    # Values don't overlap and hold tokens whole, so the tokens in question stand between a value and the next one.
    df = _barrier(df, at="if(size(scored) > 0, filter(sequence(0, size(scored) - 1), i -> get(scored, i).place = 0), cast(array() as array<int>))")
    df = _barrier(df, groups="transform(at, (a, k) -> struct(get(scored, a) as v, slice(scored, a + 2, coalesce(get(at, k + 1), size(scored)) - a - 1) as rest))")
    wins = "forall(g.rest, t -> t.start >= g.v.stop or t.score <= g.v.score)"
    df = _barrier(df, kept=f"concat(slice(scored, 1, coalesce(get(at, 0), size(scored))), flatten(transform(groups, g -> if({wins}, concat(array(g.v), filter(g.rest, t -> t.start >= g.v.stop)), g.rest))))").drop("scored", "at", "groups")
    return _barrier(df, found="array_sort(concat(base, transform(kept, c -> struct(4 as rank, c.kind as kind, c.start as start, c.stop as stop))))").drop("kept", "text")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, comma-joined) of each row."""
    df = spans(docs, id_col, text_col)
    listed = "concat_ws(',', transform({}, s -> concat(s.kind, ':', s.start, ':', s.stop)))"
    return df.select(
        F.col(id_col),
        *(F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE_KINDS),
        F.expr(f"sha2({listed.format('base')}, 256)").alias("base_sha256"),
        F.expr(listed.format("found")).alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the found spans of the text replaced by [KIND]; other columns, and null texts, stay."""
    names = docs.columns
    plain = docs.select(*(F.col(c).alias(f"c_{i}") for i, c in enumerate(names)))
    where = {c: f"c_{i}" for i, c in enumerate(names)}
    df = spans(plain, where[id_col], where[text_col], keep=tuple(plain.columns))
    df = _barrier(df, by_start="array_sort(transform(found, s -> struct(s.start as start, s.stop as stop, s.kind as kind)))")
    # Where the spans before each one end, and where all end: greatest stops so far, by blocks.
    most = "aggregate(slice({a}, {first}, {n}), 0, (a, x) -> greatest(a, x.stop))"
    df = _barrier(df, tops=f"if(size(by_start) > 0, transform(sequence(0, (size(by_start) - 1) div {BLOCK}), b -> struct({most.format(a='by_start', first=f'cast(b as int) * {BLOCK} + 1', n=BLOCK)} as stop)), cast(array() as array<struct<stop:int>>))")
    df = _barrier(df, ends=f"transform(tops, (x, b) -> {most.format(a='tops', first=1, n='b')})")
    df = _barrier(df, cuts=f"transform(by_start, (s, i) -> struct(s.start as start, s.kind as kind, greatest(get(ends, i div {BLOCK}), {most.format(a='by_start', first=f'cast(i div {BLOCK} as int) * {BLOCK} + 1', n=f'i % {BLOCK}')}) as from))", last=most.format(a="by_start", first=1, n="size(by_start)"))
    # Each span from where the spans before it end; what lies inside an earlier one goes without a mark of its own.
    t = where[text_col]
    df = _barrier(df, chars=f"if(size(cuts) > {FEW}, split({t}, ''), cast(array() as array<string>))")
    by_place = f"concat(array_join(transform(cuts, s -> if(s.start < s.from, '', concat(substring({t}, s.from + 1, s.start - s.from), '[', upper(s.kind), ']'))), ''), substring({t}, last + 1))"
    by_list = "concat(array_join(transform(cuts, s -> if(s.start < s.from, '', concat(array_join(slice(chars, s.from + 1, s.start - s.from), ''), '[', upper(s.kind), ']'))), ''), array_join(slice(chars, last + 1, size(chars)), ''))"
    clean = f"if(size(cuts) = 0, {t}, if(size(cuts) > {FEW}, {by_list}, {by_place}))"
    return df.select(*(F.expr(clean).alias(c) if c == text_col else F.col(where[c]).alias(c) for c in names))
