"""Operators 11 to 13 against plain Python and DuckDB, edge cases, and scratch tables of several threads."""

import hashlib
import math
import os
import random
import re
import threading
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.llm import embeddings, fim, merkle
from tamarack.llm.common import dropped, passing, written
from tests.conftest import SF

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
order = lambda rows: sorted((tuple(r) for r in rows), key=repr)


def texts():
    r = random.Random(3)
    pieces = ["ab", "<", "P", ">", "é", "😀", " ", "\n", "Word", "S", "M", "\t", "ß", "0"]
    out = [(k, "".join(r.choice(pieces) for _ in range(r.randint(0, 90)))) for k in range(300)]
    out += [(7, out[7][1]), (7, "another"), (None, "no id"), (None, None), (400, None), (401, ""), (402, "a<S>b"), (403, "x" * 150_000), (404, "ab 😀é\n" * 30_000), (-5, "negative id here"), ((1 << 60) + 1, "a large id")]
    return out


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text))


def test_fim_is_the_plain_cut(spark):
    rows = texts()
    docs = spark.createDataFrame([(*r, None, None) for r in rows], "doc_id long, text string, n long, output string")
    assert order(fim.report(docs).collect()) == order(plain_fim(*r) for r in rows)
    assert fim.report(docs.limit(0)).collect() == []
    assert {(x.doc_id, x.text) for x in fim.restored(fim.transformed(docs)).collect()} == {(i, t or "") for i, t in rows}


def test_ropes():
    r = random.Random(8)
    for i, text in texts():
        if len(text or "") > 1000 and i == 403:
            continue
        text, units = text or "", fim.UNIT.findall(text or "")
        rope = fim.rope(text, r.choice([1, 2, 5, 40]))
        assert (rope.units, rope.chars, str(rope)) == (len(units), len(text), text)
        k = r.randint(0, len(units))
        a, b = fim.split_units(rope, k)
        assert (str(a), str(b), a.units, b.units) == ("".join(units[:k]), "".join(units[k:]), k, len(units) - k)
        k = r.randint(0, len(text))
        a, b = fim.split_chars(rope, k)
        assert (str(a), str(b), a.units) == (text[:k], text[k:], len(fim.UNIT.findall(text[:k])))
    long = fim.rope("a b " * 50_000)
    assert long.depth <= 2 * math.log2(long.chars / fim.LEAF) + 2


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: sha("".join(map(field, (r[0], r[3], r[2], n, r[1]))))

    def tree(leaves):
        paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
        while len(level) > 1:
            for p, k in zip(paths, at, strict=True):
                p.append(None if k ^ 1 >= len(level) else (k & 1, level[k ^ 1]))
            level = [sha("".join(level[k : k + 2])) for k in range(0, len(level), 2)]
            at = [k >> 1 for k in at]
        return level[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    subs = {g: (tree([x[2] for x in sorted(v, key=lambda x: x[:3])]), sorted(v, key=lambda x: x[:3])) for g, v in groups.items()}
    names = sorted(subs, key=lambda g: (g is not None, (g or "").encode()))
    root, above = tree([subs[g][0][0] for g in names])
    out = []
    for g, upper in zip(names, above, strict=True):
        (subroot, paths), members = subs[g]
        for (_, _, own, r), path in zip(members, paths, strict=True):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            d = leaf(r, r[4] + 1) if bad else own
            for step in path + upper:
                d = sha(d) if step is None else sha(step[1] + d) if step[0] else sha(d + step[1])
            out.append((r[0], own, subroot, root, sha("".join(s[1] for s in path + upper if s)), d, d == root))
    return out


@pytest.mark.parametrize("levels", [1, 3, 8])
def test_manifest_is_the_plain_tree(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "NODES", 50)
    r = random.Random(levels)
    sizes = {None: 5, "": 1, "de": 2, "en": 301, "é": 3, "z": 64}
    rows = [(k * 10 + i, f"text {k} ß" * r.randint(0, 3), lang, r.choice(["s1", None]), r.choice([3, None, 17])) for i, (lang, n) in enumerate(sizes.items()) for k in range(n)]
    rows += [rows[7], rows[7], (None, None, None, None, None), (None, "x", "en", "s", 1), (None, "y", "en", "s", 1), (3, "other text of id 3", "en", None, 2), (12, "long " * 40_000, "en", "s", 1)]
    docs = spark.createDataFrame([(*x, "a", 1, 2) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, leaf string, place long, tree long")
    assert order(merkle.report(docs.repartition(3), levels).collect()) == order(plain_manifest(rows))
    assert merkle.report(docs.limit(0), levels).collect() == []
    one = docs.filter("doc_id = 12 and n_chars = 1")
    assert order(merkle.report(one, levels).collect()) == order(plain_manifest([rows[-1]]))


def test_manifest_finds_what_changed(spark):
    docs = spark.createDataFrame([(k, f"t{k}", "en") for k in range(40)], "doc_id long, text string, lang string")
    got = merkle.manifest(docs, ["doc_id", "text"], "lang", {"text": F.concat("text", F.lit("."))}, F.col("doc_id") == 11).collect()
    assert {r.doc_id for r in got if not r.verified} == {11} and len({r.root for r in got}) == 1
    assert all(r.verified for r in merkle.manifest(docs, ["doc_id", "text"], "lang").collect())
    assert merkle.manifest(docs.filter("doc_id <> 4"), ["doc_id", "text"], "lang").first().root != got[0].root


@pytest.mark.parametrize("name,module,table", [("op11", fim, "documents"), ("op12", merkle, "documents"), ("op13", embeddings, "embeddings")])
def test_sql_agrees(spark, name, module, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = module.report(spark.read.parquet(f"{SF}/{table}.parquet"))
    want = con.sql(module.ORACLE)
    assert got.columns == want.columns and order(got.collect()) == order(want.fetchall())


def near_vectors(d=48):
    """Groups of near copies, tight, on the edge and chained; exact and scaled copies; unlike ones; what cannot link."""
    r = np.random.default_rng(6)
    unit = lambda n: (x := r.normal(size=(n, d))) / np.linalg.norm(x, axis=1)[:, None]
    rows, label = [], 0

    def add(vectors, lab):
        for v in vectors:
            rows.append((len(rows), None if v is None else [float(x) for x in v], lab))

    add(unit(150), 0)
    for spread, n, lab in ((0.02, 60, 0), (0.13, 60, 1), (0.2, 40, 1), (0.005, 50, 2)):
        hub = unit(1)
        g = unit(n)
        g = g - (g @ hub.T) * hub
        add(hub + spread * g / np.linalg.norm(g, axis=1)[:, None], lab)
    chain, step = [unit(1)[0]], unit(1)[0]
    for k in range(20):
        chain.append(chain[0] * math.cos(0.15 * k) + step * math.sin(0.15 * k))
    add(chain, 3)
    v = unit(1)[0]
    add([v, v, v * 3, v * 1e-200, v * 1e250, -v], 4)
    add([v, v], 5)  # another label
    add([v, v], None)
    bad = v.copy()
    add([None, np.zeros(d), bad * float("inf"), np.append(bad[:-1], float("nan")), v[:20], v[:20]], 4)
    rows.append((len(rows), [None, 1.0], 4))
    rows.append((len(rows), [], 4))
    rows += [(None, rows[0][1], 0), (3, rows[3][1], 0), (3, rows[5][1], 0)]
    return rows


def plain_links(rows, least=0.98):
    def sound(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    unit = []
    for _, v, lab in rows:
        x = np.array(v, float) / np.abs(np.array(v, float)).max() if lab is not None and sound(v) else None
        unit.append(None if x is None else x / np.linalg.norm(x))
    n, root = [0] * len(rows), list(range(len(rows)))
    pairs = []
    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                n[a] += 1
                n[b] += 1
                pairs.append((a, b))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            lo = min(root[a], root[b])
            changed |= root[a] != lo or root[b] != lo
            root[a] = root[b] = lo
    out = []
    for k, (i, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[k] and rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((i, n[k], c, i is not None and i == c))
    return out


@pytest.mark.parametrize("most", [embeddings.MOST, 8])
def test_embeddings_are_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(embeddings, "STRIPE", 5)
    monkeypatch.setattr(embeddings, "PAIRS", 7)
    rows = near_vectors()
    table = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, code string, n long, kind long")
    got, want = order(embeddings.linked(table, most=most).collect()), order(plain_links(rows))
    # what hashing may miss, one pair in thousands: the few rows that differ have a link too few
    unlike = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert len(unlike) <= 4 and sum(g[1] for g in got) >= 0.999 * sum(w[1] for w in want)
    assert all(g[0] == w[0] and g[1] <= w[1] for g, w in unlike)
    assert embeddings.linked(table.limit(0)).collect() == []


def test_recall_on_the_edge():
    r = np.random.default_rng(2)
    x = r.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = r.normal(size=x.shape)
    g -= (g * x).sum(1)[:, None] * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * g / np.linalg.norm(g, axis=1)[:, None]
    met = np.zeros(len(x), bool)
    for t in range(embeddings.TABLES):
        a, b = embeddings.codes(x, t), embeddings.codes(y, t)
        met |= (a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)
    assert met.mean() >= 0.999


def test_threads_keep_their_tables(spark):
    """One thread's frame ends while the other still reads its table."""
    made, ended, failed = threading.Event(), threading.Event(), []

    def keeps():
        try:
            with passing():
                table = written(spark.range(10), "thread-one")
                made.set()
                ended.wait(60)
                assert table.count() == 10 and os.path.exists(table.scratch_path.removeprefix("file:"))
            assert not os.path.exists(table.scratch_path.removeprefix("file:"))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    def ends():
        try:
            made.wait(60)
            with passing() as own:
                kept = written(spark.range(5), "thread-two")
                other = written(spark.range(5), "thread-two")
                own.keep(kept)
            ended.set()
            assert kept.count() == 5 and not os.path.exists(other.scratch_path.removeprefix("file:"))
            dropped(kept)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=f) for f in (keeps, ends)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert not failed


def test_shuffles_go_and_the_setting_returns(spark):
    from tamarack.llm import common

    before = spark.conf.get(common._CLEANUP, "false")
    table = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "cleaned")
    assert table.count() == 7 and spark.conf.get(common._CLEANUP) == before
    dropped(table)
