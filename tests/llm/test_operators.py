"""The operators on odd rows (nulls, empties, repeats, clashing columns, empty tables), against brute force."""

import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fanloom.llm import decontaminate, grulm, htmlwrap, langid, lines, minhash, ngramjoin, pii, sentencepieces, warc


def text_words(t):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def grams(t, n):
    w = text_words(t)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def components(nodes, pairs):
    up = {k: k for k in nodes}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in pairs:
        up[find(a)] = find(b)
    return {k: find(k) for k in nodes}


def brute_groups(rows, n, t):
    """Groups of (doc_id, text) that pairs over the threshold connect."""
    docs = sorted({(r[0], r[1]) for r in rows if grams(r[1], n)}, key=lambda d: (d[0] is None, d[0] or 0, d[1]))
    sets = {d: grams(d[1], n) for d in docs}
    pairs = [(a, b) for a, b in itertools.combinations(docs, 2) if jaccard(sets[a], sets[b]) >= t]
    return docs, pairs


def expected_ids(rows, n, t):
    docs, pairs = brute_groups(rows, n, t)
    return {(min(a[0], b[0]), max(a[0], b[0])) for a, b in pairs if None not in (a[0], b[0]) and a[0] != b[0]}


def closure(pairs):
    where = components({x for p in pairs for x in p}, pairs)
    return {frozenset((a, b)) for a, b in itertools.combinations(where, 2) if where[a] == where[b]}


def test_ngram_join(docs, corpus, none):
    pairs, nodes = ngramjoin.near_pairs(docs, 4, 0.5)
    got = {(r.doc_a, r.doc_b): r.jaccard for r in ngramjoin.pair_rows(pairs, nodes).collect()}
    want = expected_ids(corpus, 4, 0.5)
    assert set(got) <= want and closure(got) == closure(want)  # copies are linked with the one that stands for them
    text = {r[0]: r[1] for r in corpus if r[0] not in (6, None)}
    assert all(abs(jaccard(grams(text[a], 4), grams(text[b], 4)) - j) < 1e-9 for (a, b), j in got.items() if 6 not in (a, b))
    assert ngramjoin.pair_rows(*ngramjoin.near_pairs(none, 4, 0.5)).count() == 0


def copies(rows):
    """The corpus with three near copies of a text that has four equal ones, and further copies of one of them."""
    near = " ".join(rows[3][1].split(" ")[:-1])
    return rows + [(k, rows[3][1] if k % 2 else near, *rows[3][2:]) for k in range(90, 96)]


def test_ngram_join_has_all_pairs(spark, docs, corpus):
    rows = copies(corpus)
    pairs, nodes = ngramjoin.near_pairs(spark.createDataFrame(rows, docs.schema).repartition(3), 4, 0.5)
    for part in (ngramjoin.PART, 2):
        got = [(r.doc_a, r.doc_b) for r in ngramjoin.pair_rows(pairs, nodes, part).collect()]
        once = [p for p in got if 6 not in p]  # id 6 has two texts
        assert set(got) == expected_ids(rows, 4, 0.5) and len(once) == len(set(once))


def test_ngram_join_pairs_of_stand_ins_equal_sql(spark, docs, corpus, tmp_path):
    import duckdb

    first = {r[0]: r for r in reversed(copies(corpus)) if r[0] is not None and r[1] is not None}
    spark.createDataFrame(list(first.values()), docs.schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_a, r.doc_b, round(r.jaccard, 9)) for r in ngramjoin.stand_in_rows(*ngramjoin.near_pairs(spark.read.parquet(f"{tmp_path}/documents.parquet"))).collect()]
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = [(a, b, round(j, 9)) for a, b, j in duck.execute(ngramjoin.OP9_SQL).fetchall()]
    assert sorted(got) == sorted(want) and len(got) > 20
    assert closure([r[:2] for r in got]) == closure(expected_ids(list(first.values()), 4, 0.5))


def test_ngram_join_query_equals_sql(spark, docs, corpus, tmp_path):
    import duckdb

    rows = copies(corpus)  # odd rows included: null ids and texts, repeated rows, one id with two texts
    spark.createDataFrame(rows, docs.schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in ngramjoin.op9_ngram_join(spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == Counter(duck.execute(ngramjoin.OP9_CLASSES_SQL).fetchall())


def test_ngram_join_classes_and_links(spark, docs, corpus, none):
    texts = [" ".join(f"w{k}" for k in range(200) if k != gone) for gone in range(60)]  # 60 near copies, 1,770 pairs
    rows = copies(corpus) + [(1000 + k, t, *corpus[3][2:]) for k, t in enumerate(texts)]
    nodes, pairs = brute_groups(rows, 4, 0.5)
    every = {(r[0], r[1]) for r in rows}
    groups, degree = components(every, pairs), Counter(x for p in pairs for x in p)
    ids = {g: min((d[0] for d in every if groups[d] == g and d[0] is not None), default=None) for g in set(groups.values())}
    want = Counter((d[0], ids[groups[d]], degree[d]) for d in every)
    df = spark.createDataFrame(rows, docs.schema).repartition(3)
    for part in (ngramjoin.PART, 20):
        got = Counter(tuple(r) for r in ngramjoin.near_classes(df, part=part).collect())
        assert got == want and sum(got.values()) == len(every)
    assert {k: n for k, _, n in want if k is not None and k >= 1000} == {1000 + k: 59 for k in range(60)}
    assert ngramjoin.near_classes(none).count() == 0


def test_minhash(docs, corpus, none):
    got = {(r.doc_a, r.doc_b) for r in minhash.near_duplicates(docs).collect()}
    want = expected_ids(corpus, 3, 0.6)
    assert got <= want and len(closure(got)) >= 0.9 * len(closure(want))
    assert minhash.near_duplicates(none).count() == 0


def test_minhash_recall_of_pairs(spark, docs, corpus):
    rows = copies(corpus)
    got = {(r.doc_a, r.doc_b) for r in minhash.near_duplicates(spark.createDataFrame(rows, docs.schema).repartition(3)).collect()}
    want = expected_ids(rows, 3, 0.6)
    assert got <= want and len(got) >= 0.9 * len(want)


def test_minhash_classes_and_links(spark, docs, corpus, none, monkeypatch):
    rows = copies(corpus)
    df = spark.createDataFrame(rows, docs.schema).repartition(3)
    nodes, pairs = brute_groups(rows, 3, 0.6)
    every = {(r[0], r[1]) for r in rows}
    groups, degree = components(every, pairs), Counter(x for p in pairs for x in p)
    want = Counter((d[0], degree[d]) for d in every)
    got = minhash.near_classes(df).collect()
    assert len(got) == len(every) and Counter(r.doc_id for r in got) == Counter(d[0] for d in every)
    assert sum(min(r.n_links, max(degree[d] for d in every if d[0] == r.doc_id)) for r in got) >= 0.9 * sum(degree.values())
    # bands of one row link all pairs of such Jaccard: the exact classes and numbers
    for part in (ngramjoin.PART, 2):
        monkeypatch.setattr(minhash, "block_parts", lambda r, b, n, part=part: ngramjoin.block_parts(r, b, n, part))
        got = minhash.near_classes(df, count=60, width=1).collect()
        assert Counter((r.doc_id, r.n_links) for r in got) == want
        once = {r.doc_id: r.class_id for r in got if r.doc_id not in (6, None)}
        brute = {d[0]: groups[d] for d in every if d[0] in once}
        assert len({(once[k], brute[k]) for k in once}) == len(set(once.values())) == len(set(brute.values()))
    assert minhash.near_classes(none).count() == 0


def test_minhash_query_has_a_row_a_document(spark, docs, corpus, tmp_path):
    rows = [r for r in corpus if r[0] is not None] + [(k, corpus[3][1], *corpus[3][2:]) for k in range(1000, 1060)]
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = minhash.op1_minhash(spark, str(tmp_path)).collect()
    assert len(got) == len({(r[0], r[1]) for r in rows})
    same = [r for r in got if r.doc_id == 3 or r.doc_id >= 1000]
    assert len({r.class_id for r in same}) == 1 and min(r.n_links for r in same) >= 63  # itself aside: 60 and the three copies


def test_keep_one(docs, corpus):
    kept = [(r.doc_id, r.text) for r in ngramjoin.keep_one(docs, 4, 0.5).collect()]
    nodes, pairs = brute_groups(corpus, 4, 0.5)
    groups = components(nodes, pairs)
    least = {}
    for d in nodes:  # in the order of ids; texts of one id are ordered by hash, so only ids count here
        least.setdefault(groups[d], d[0])
    assert sorted(k[0] for k in kept if k[0] is not None and grams(k[1], 4)) == sorted(v for v in least.values() if v is not None)
    assert sum(1 for k in kept if not grams(k[1], 4)) == sum(1 for r in corpus if not grams(r[1], 4))


def brute_lines(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if r[1] is None:
            out.append((r[0], None))
            continue
        kept = []
        for line in r[1].split("\n"):
            key = line.strip(" \t\r\f\x0b")
            if key == "" or key not in seen:
                kept.append(line)
            seen.add(key)
        out.append((r[0], "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_line_dedup(docs, corpus, none, batches):
    got = lines.dedup_lines(docs, batches=batches, fanout=2)
    assert got.columns[: len(docs.columns)] == docs.columns
    # texts of one id are ordered by hash: compare with ids that have one text
    once = lambda rows: Counter((a, b) for a, b in rows if a != 6)
    assert once((r.doc_id, r.text) for r in got.collect()) == once(brute_lines(corpus))
    assert lines.dedup_lines(none, batches=batches).count() == 0


def test_runs_compact(spark):
    runs = lines.LineRuns(spark, fanout=2)
    for k in range(5):
        runs.add(spark.range(10 * k, 10 * k + 10).select(F.col("id").alias("h1"), F.col("id").cast("int").alias("h2")))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    probe = spark.range(60).select(F.col("id").alias("h1"), F.col("id").cast("int").alias("h2"))
    assert runs.unseen(probe).count() == 10
    runs.drop()


def test_decontamination(spark, docs, corpus, none):
    a = text_words(corpus[0][1])
    items = [(0, corpus[1][1]), (1, " ".join(a[6:12] + a[:6])), (2, "one"), (3, None), (4, ""), (5, "nothing of this is anywhere in it"), (6, corpus[1][1]), (None, corpus[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert {(1, 0), (1, 6), (0, 1), (74, 2), (75, 2), (2, None)} <= got
    assert not {i for _, i in got} & {3, 4, 5}
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in corpus} - {d for d, _ in got}
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_language(docs, corpus, none):
    model = langid.trained(docs)
    got = langid.identify(docs, model)
    assert got.count() == len(corpus)
    odd = got.where("doc_id in (70, 71, 72)").collect()
    assert {(r.lang_pred, r.accepted, r.posterior) for r in odd} == {("und", False, None)}
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == got.where("accepted").count()
    nothing = langid.trained(none)
    assert nothing.langs == [] and langid.identify(docs, nothing).where("accepted").count() == 0 and langid.identify(none, nothing).count() == 0


def test_tokens(docs, corpus, none):
    got = sentencepieces.encode_column(docs)
    names = got.columns[-4:]
    assert got.columns[: len(docs.columns)] == docs.columns and names == ["_ids", "n_tokens", "round_trip", "matches_library"]
    rows = got.collect()
    assert len(rows) == len(corpus) and all((r._ids is None) == (r.text is None) for r in rows)
    assert all(r.round_trip and r.matches_library for r in rows if r.text is not None)
    back = sentencepieces.decode_column(got, ids_col="_ids").select("text", "decoded").collect()
    assert all(a == b for a, b in back)
    assert sentencepieces.encode_column(none).count() == 0


def test_pii_rows(spark, docs, corpus, none):
    got = pii.redact(docs)
    rows = got.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r[0], r[1]) for r in corpus)  # nothing private in these
    assert pii.redact(none).count() == 0
    one = spark.createDataFrame([(1, "write to a.12@mail3.example.com now")], "doc_id long, text string")
    r = pii.redact(one).first()
    assert r.text == "write to [EMAIL] now" and r.spans[0].start == 9


def test_scores(docs, corpus, none):
    rows = grulm.score_documents(docs, share=2, rounds=1).collect()
    assert len(rows) == len(corpus) and all(r.log_likelihood < 0 for r in rows)
    empty = [r for r in rows if r.doc_id in (70, 71, 72)]
    assert len({round(r.log_likelihood, 4) for r in empty}) == 1 and all(r.n_words == 0 for r in empty)
    assert grulm.score_documents(none, share=2, rounds=1).count() == 0


def test_every_document_trains(spark):
    """With the query's own parameters, a document of any hash changes the model."""
    lex = grulm.lexicon(spark.createDataFrame([("one two three two",)], "text string"))
    first = grulm.Gru(lex.frequency).flat()
    for h in (1, 17, 31):
        texts = spark.createDataFrame([(h, "one two three two")], "h long, text string")
        assert (grulm.train(texts, lex, grulm.SHARE, grulm.ROUNDS).flat() != first).any()


PAGES = "page_id long, url string, html string, host string, shape string, payload string, record_id string"


def page(k, url, html):
    return (k, url, html, "x", "y", "z", "w")


def test_html(spark):
    make = lambda k, text, foot="same foot": page(k, f"http://a.org/{k}", f"<body><div><p>menu</p></div><article><p>{text}</p></article><footer>{foot}</footer></body>")
    rows = [make(k, f"text {k}") for k in range(6)] + [make(6, "text 6", "other")] + [make(0, "text 0"), page(None, None, None), page(9, "odd", ""), page(10, "http://b.org/", "<p>menu</p>"), page(11, "http://b.org:80/x", "<p>own</p>")]
    df = spark.createDataFrame(rows, PAGES)
    got = {(r.page_id, r.host): (r.content, r.n_template) for r in htmlwrap.extract(df).collect()}
    assert got[1, "a.org"] == ("text 1", 2) and got[6, "a.org"] == ("text 6\nother", 1)
    assert got[None, ""] == ("", 0) and got[10, "b.org"] == ("menu", 0)
    assert htmlwrap.extract(df).count() == len(rows) and htmlwrap.extract(df.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    rows = [page(1, "http://a/", "<p>x</p>"), page(1, "http://a/", "<p>x</p>"), page(2, "http://b/", "<p>x</p>"), page(4, "http://c/", "é" * 9), page(None, None, None), page(5, "u\r\nX: y", "\r\n\r\nz")]
    df = spark.createDataFrame(rows, PAGES)
    records = warc.captures(df)
    got = {(r.target_uri, r.warc_date[11:13], r.status): r for r in warc.resolve(records).collect()}
    assert Counter(k[2] for k in got) == {"original": 4, "deduplicated": 1, "revisit": 2}
    assert {r.refers_to_uri for r in got.values() if r.target_uri == "http://b/"} == {"http://a/"}
    lone = records.where("warc_type = 'revisit'").limit(1)
    assert warc.resolve(lone).first().status == "unresolved"
    path = f"file://{tmp_path}/w"
    warc.write_archives(warc.with_records(records, warc.resolve(records)), path, 2)
    back = warc.read_archives(spark, path)
    want = {r.record_id: (r.warc_type, r.target_uri, r.payload_digest) for r in warc.resolve(records).collect()}
    found = back.collect()
    assert {r.record_id: (r.warc_type, r.target_uri, r.payload_digest) for r in found} == want and len(found) == len(want)
    assert all(r.payload_digest == "sha1:" + __import__("hashlib").sha1(r.payload.encode()).hexdigest() for r in found if r.warc_type == "response")
    assert warc.resolve(back).where("status = 'revisit'").count() == 3  # what is written resolves again
    assert warc.resolve(warc.captures(df.limit(0))).count() == 0


def test_pipeline(spark, docs, corpus, tmp_path):
    """Each stage against brute force on its own input."""
    sf = str(tmp_path)
    a = text_words(corpus[10][1])
    spark.createDataFrame([(0, " ".join(a[:8])), (1, corpus[20][1])], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    data = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in data.collect()]
        out = stage(spark, data, sf)
        out.write.parquet(f"{sf}/{name}")
        out = spark.read.parquet(f"{sf}/{name}")
        after = [(r.doc_id, r.text) for r in out.collect()]
        if k < 4:
            assert out.columns == docs.columns
        if name == "language_id":
            assert {d for d, t in before} - {d for d, t in after} <= {70, 71, 72, 73, 76} and not [t for _, t in after if not (t or "").strip()]
        elif name == "line_dedup":
            want = Counter((d, t) for d, t in brute_lines(before) if d != 6 and t.strip())
            assert Counter((d, t) for d, t in after if d != 6) == want
        elif name == "near_duplicates":
            nodes, pairs = brute_groups(before, 4, 0.5)
            assert len(after) == len(set(components(nodes, pairs).values())) + sum(1 for _, t in before if not grams(t, 4))
        elif name == "decontamination":
            bad = {d for d, t in before if d in (10, 20)}
            assert bad and {d for d, _ in before} - {d for d, _ in after} == bad
        else:
            assert out.where("round_trip and matches_library").count() == len(before)
        data = out
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.run(spark, sf).count() == data.count()
