"""Chat formatting, vectors, the pipeline and the registered queries."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from locusfold.llm import chat, embed, queries


def test_chat_reads_back(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    evil = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[", "<s> x </s", "", None, " [/TURN]", "[\\INST]"]
    extra = spark.createDataFrame(
        [(-1, k, role, t) for k, (t, role) in enumerate(zip(evil, ["user", "assistant", "system", "tool", None, "assistant", "user", "[ROLE]", "assistant"]))] + [(None, 0, "user", "x"), (7000, None, "user", "y"), (7000, None, "user", "y")],
        turns.schema,
    )
    every = turns.unionByName(extra)
    conv = defaultdict(list)
    for r in every.collect():
        conv[r.conv_id].append((r.turn is not None, r.turn, r.role or "", r.text or ""))
    got = {r.conv_id: r for r in chat.format_report(every).collect()}
    assert got.keys() == conv.keys()
    for k, rows in conv.items():
        rows.sort(key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
        assert got[k].n_turns == len(rows)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in rows).encode()).hexdigest()
        learnt = "".join(r[3] for r in rows if r[2] == "assistant")
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    segments = chat.format_segments(every).collect()
    total = defaultdict(int)
    for s in segments:
        total[s.conv_id] += len(s.text)
    assert {k: r.formatted_chars for k, r in got.items()} == total
    assert chat.format_report(every.filter("false")).count() == 0


def test_turn_order():
    def valid(*roles):
        order = chat.TurnOrder(chat.Template())
        for r in roles:
            order.turn(r)
        return order.valid

    assert valid("user", "assistant") and valid("system", "user", "assistant", "user", "assistant")
    assert not valid("assistant") and not valid("user", "user", "assistant") and not valid("user") and not valid()


def test_vectors(spark):
    rng = np.random.default_rng(9)
    rows, n = [], 0
    for _ in range(40):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 6)):
            rows.append((n, (centre + rng.normal(size=16) * 0.05 * rng.integers(0, 3)).tolist(), int(rng.integers(0, 2))))
            n += 1
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, rows[0][1], None), (n + 2, None, 1), (n + 3, [0.0] * 16, 1), (n + 4, [float("nan")] * 16, 1), (n + 5, [1.0, None] + [0.0] * 14, 1), (n + 6, [1.0, 2.0], 1), (n + 7, [], 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, rep string")
    good = {i: np.array(v) / np.linalg.norm(v) for i, v, lab in rows if lab is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    label = {i: lab for i, _, lab in rows}
    links = {i: [j for j in good if j != i and label[i] == label[j] and good[i] @ good[j] >= 0.98] for i in good}
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, js in links.items():
        for j in js:
            u, v = find(i), find(j)
            parent[max(u, v)] = min(u, v)
    got = {r.vec_id: tuple(r)[1:] for r in embed.link_vectors(df).collect()}
    assert got == {i: (len(links.get(i, [])), find(i), find(i) == i) for i in parent}
    assert embed.link_vectors(df.filter("false")).count() == 0


def test_vectors_of_any_size(spark):
    """Squares that over- or underflow; equal, repeated and null ids."""
    rows = [(1, [1e200, 1e200], 0), (2, [1e200, 1e200], 0), (3, [1e-200, 1e-200], 0), (4, [2e-200, 2e-200], 0), (5, [1.0, -1.0], 0), (6, [1.0, -1.0], 1), (7, [0.0, 0.0], 0), (8, [1e300, -1e300], 0), (None, [1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: tuple(r)[1:] for r in embed.link_vectors(df).collect()}
    assert got == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 4: (3, 1, False), 5: (1, 5, True), 6: (0, 6, True), 7: (0, 7, True), 8: (1, 5, False), None: (0, None, True)}


def test_recall_of_the_probes(spark):
    """More rows than a list holds, so that pairs lie on both sides of borders: all are found, also without the exact margin."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(700, 64))
    x = np.vstack([x / np.linalg.norm(x, axis=1)[:, None]] * 2)
    way = rng.normal(size=(700, 64))
    x[700:] += way / np.linalg.norm(way, axis=1)[:, None] * rng.uniform(0.05, 0.25, 700)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    labels = np.tile(np.arange(700) % 2, 2)
    v = spark.createDataFrame([(i, e.tolist(), int(g)) for i, (e, g) in enumerate(zip(x, labels))], "vec_id long, embedding array<double>, label int")
    linked = (x @ x.T >= 0.98) & (labels[:, None] == labels[None])
    want = dict(enumerate((linked.sum(1) - 1).tolist()))
    before = embed.BLOCK
    embed.BLOCK = 100
    try:
        for sigmas in (4.5, None):
            got = {a.vec_id: a.n_links for a in embed.link_vectors(v, sigmas=sigmas).collect()}
            assert sum(got.values()) > 0 and got == {i: want.get(i, 0) for i in got}
    finally:
        embed.BLOCK = before


@pytest.mark.parametrize("rank", [2, 3])
@pytest.mark.parametrize("block", [32, 1000])
def test_no_pair_is_missed_near_a_subspace(spark, rank, block):
    """Vectors of 64 dimensions near a plane or a space, where neighbours lie across borders of lists head on."""
    rng = np.random.default_rng(rank)
    x = rng.normal(size=(3000, rank)) @ rng.normal(size=(rank, 64)) + rng.normal(size=(3000, 64)) * 1e-4
    x /= np.linalg.norm(x, axis=1)[:, None]
    v = spark.createDataFrame([(i, e.tolist(), 0) for i, e in enumerate(x)], "vec_id long, embedding array<double>, label int")
    want = ((x @ x.T >= 0.98).sum(1) - 1).tolist()
    before, embed.BLOCK = embed.BLOCK, block
    try:
        got = {r.vec_id: r.n_links for r in embed.link_vectors(v).collect()}
    finally:
        embed.BLOCK = before
    assert sum(want) > 0 and [got[i] for i in range(3000)] == want


def test_repeated_ids_have_links_of_their_own(spark):
    """Id 5 has v and w: v has one link, w has two; both rows and all they reach are one component. So does an id in two labels."""
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, v, 0), (5, w, 0), (7, [1.0, 0.01, 0.0], 0), (8, [0.01, 1.0, 0.0], 0), (9, [0.0, 1.0, 0.01], 0), (3, w, 1), (5, w, 1), (11, None, 1), (11, v, 2)]
    got = sorted(tuple(r) for r in embed.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    # 3 and 5 are equal in label 1, so that the component of 5 starts at 3
    assert got == sorted([(5, 1, 3, False), (5, 2, 3, False), (7, 1, 3, False), (8, 2, 3, False), (9, 2, 3, False), (3, 1, 3, True), (5, 1, 3, False), (11, 0, 11, True), (11, 0, 11, True)])


def plain_pipeline(rows, language):
    """(doc_id, text) of what reaches packing, by brute force; `language` tells which rows the classifier keeps."""
    rows = [r for r in rows if r[0] in language]
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    holders = defaultdict(list)
    for i in sorted(sets):
        for x in sets[i]:
            holders[x].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        met = defaultdict(int)
        for x in sets[i]:
            for j in holders[x]:
                met[j] += 1
        for j, n in met.items():
            if j < i and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                u, v = find(i), find(j)
                parent[max(u, v)] = min(u, v)
    rows = sorted((i, t.encode()) for i, t in rows if find(i) == i)
    first = {}
    for i, b in rows:
        for k in range(len(b) - 49):
            first.setdefault(b[k:k + 50], i)
    out = []
    for i, b in rows:
        mark = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < i:
                mark[k:k + 50] = True
        out.append((i, np.frombuffer(b, np.uint8)[~mark].tobytes().decode("utf-8", "ignore")))
    return out


def test_pipeline_against_a_plain_one(spark, sf_dir, docs):
    from locusfold.llm import langid, packing, secrets
    from locusfold.llm.queries import PACK_TOKENIZER, tokenizer_path
    from tokenizers import Tokenizer

    known = {r.doc_id for r in langid.identify(docs).collect() if r.lang_pred != "und" and r.score >= 0.4}
    rows = plain_pipeline([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.text is not None], known)
    spans = {r.doc_id: r.spans for r in secrets.scan_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    tok = Tokenizer.from_file(tokenizer_path(PACK_TOKENIZER))
    want = {}
    for i, t in rows:
        mark = np.zeros(len(t) + 1, bool)
        for _, a, b in (x.split(":") for x in spans[i].split(",") if x):
            mark[int(a):int(b)] = True
        t = "".join("" if mark[k] and k and mark[k - 1] else "[SECRET]" if mark[k] else c for k, c in enumerate(t))
        want[i] = len(tok.encode(t, add_special_tokens=False).ids) + 1
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r.doc_id] += r.length
    assert got == want


def test_pipeline_of_an_empty_table(spark, none):
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, None)
    assert none.count() == 0


def test_pipeline(spark, docs, odd):
    frame = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, None)
        assert out.columns == docs.columns, name
        frame = corpus_pipeline.materialize(out)
        seen.append(frame.count())
    assert seen == sorted(seen, reverse=True) and seen[0] > 0.9 * docs.count()
    ids = {r.doc_id for r in frame.select("doc_id").collect()}
    packed = corpus_pipeline.pack(spark, frame, None)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, None)
    kept = {r.doc_id for r in odd.select("doc_id").collect()}
    assert 1 in kept and not kept & {2, 3, 4, 5}


@pytest.mark.parametrize("name", list(queries.queries()))
def test_registered(name, spark, sf_dir):
    assert queries.queries()[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(name, spark, sf_dir):
    import os

    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "pages"):
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    sql = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(sql.columns)
    assert sorted(map(tuple, df.select(*sql.columns).collect())) == sorted(sql.fetchall())
