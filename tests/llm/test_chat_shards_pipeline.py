"""Chat rotation, the Feistel order and shards, and the pipeline, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import chat, decontaminate, mixing, quality, shards, simhash

from . import brute


def rotate(turns, size=chat.CHUNK_TURNS):
    out, talks = {}, {}
    for conv, turn, role, text in turns:
        talks.setdefault(conv, []).append((-1 if turn is None else turn, role or "unknown", text or ""))
    for conv, rows in talks.items():
        rows.sort()
        for who in {r for _, r, _ in rows} - {"system"}:
            for c in range(0, len(rows), size):
                text, mask, own = "", [], 0
                for _, name, said in rows[c : c + size]:
                    head = "assistant" if name == who else name if name == "system" else f"user name={name}"
                    text += f"<|start|>{head}\n"
                    start = len(text)
                    text += f"{said}<|end|>\n"
                    if name == who:
                        mask.append(f"{start}:{len(text) - 1}")
                        own += 1
                out[conv, who, c // size] = (len(rows[c : c + size]), own, text, ",".join(mask))
    return out


def test_chat(spark, sf_dir):
    odd = [(1, 0, "user", "hi"), (1, 1, None, None), (1, None, "bob", "x"), (1, 1, None, None), (None, 0, "user", "lost"), (2, 0, "system", "only")]
    odd += [(3, t, ("a", "b", "c", "system")[t % 4], f"é{t}") for t in range(-70, 200)] + [(4, 5, "a", str(k)) for k in range(150)] + [(5, 0, "a", "long \u00e9 " * 40_000), (5, 1, "b", "x")]
    schema = "conv_id long, turn long, role string, text string"
    for df in (spark.createDataFrame(odd, schema).repartition(3), spark.read.parquet(f"{sf_dir}/conversations.parquet"), spark.createDataFrame([], schema)):
        want = rotate([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
        got = {(r.conv_id, r.perspective, r.chunk): (r.n_turns, r.n_own, r.rendered, r["mask"]) for r in chat.rotate(df).collect()}
        assert got == want


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_is_a_bijection(n):
    f = shards.Feistel(n, 9)
    slots = f.slot(np.arange(n))
    assert sorted(slots) == list(range(n)) and (f.sequence(slots) == np.arange(n)).all()
    if n == 1000:
        assert not (slots == shards.Feistel(n, 10).slot(np.arange(n))).all()


def test_shards_round_trip(spark, sf_dir):
    odd = [(1, ""), (2, None), (None, "null id"), (3, "same"), (3, "same"), (4, "long é " * 4000)]
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.createDataFrame(odd, "doc_id long, text string")):
        out = shards.materialise_order(docs, length=256, per_shard=16)
        total, tokens = out.agg(F.first("total_sequences"), F.first("total_tokens")).first()
        pages = dict(shards.read_from(out))
        assert sorted(pages) == list(range(total))
        assert [s for s, _ in shards.read_from(out, total - 3)] == list(range(total))[-3:]
        order = shards.Feistel(total, shards.SEED).slot(np.arange(total))
        stream = np.concatenate([pages[s] for s in order])
        enc = shards.encoder()
        end = enc.n_vocab
        assert (stream[tokens:] == end).all()
        cuts = np.nonzero(stream[:tokens] == end)[0]
        texts = [enc.decode(part[part != end].tolist()) for part in np.split(stream[:tokens], cuts + 1)[:-1]]
        assert sorted(texts) == sorted(r.text or "" for r in docs.collect())
    assert shards.materialise_order(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_resuming_reads_only_what_follows(spark, tmp_path):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('some words to encode ', 40) AS text")
    shards.materialise_order(docs, length=64, per_shard=8).write.parquet(f"file://{tmp_path}/shards")
    stored = spark.read.parquet(f"file://{tmp_path}/shards")
    total = stored.first().total_sequences
    late = shards.shards_from(stored, total - 20)
    assert "GreaterThanOrEqual(first_slot" in late._jdf.queryExecution().toString()
    assert late.count() <= 4 and [s for s, _ in shards.read_from(stored, total - 20)] == list(range(total - 20, total))
    assert shards.shards_from(stored.limit(0), 5).count() == 0


def test_keep_one_and_remove(spark):
    rows = [(5, "a b c d e f", "x"), (2, "a b c d e f", "y"), (2, "a b c d e f", "z"), (None, "a b c d e f", "n"), (9, "other words here now and then", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = simhash.keep_one(df, width=5)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "9", "None"]
    items = spark.createDataFrame([(1, "c d e")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a B, c d-e! f g h", 1), (2, "c d e", 2), (3, None, 3)], "doc_id long, text string, spans int")
    assert sorted((r.doc_id, r.text) for r in decontaminate.remove(docs, items).collect()) == [(1, "a B, ! f g h"), (3, None)]


def test_mix_rows_match_the_digest(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()}
    want = {r.doc_id: r.taken for r in mixing.op6_mixing(spark, sf_dir).collect() if r.taken}
    assert got == want


def test_quality_rules_on_lines(spark):
    lines = ["Good prose ends here with a stop.", "Home | About | News | Contact | Login", "ALL!! OF!! THIS!! SHOUTS!!", "x### y*** z%%%", "All rights reserved by someone in some year.", "short tail", "A clean line without an end mark is long enough", "", "- list item", "2. second item", "\u3053\u308c\u306f\u65e5\u672c\u8a9e\u306e\u884c", "\u8a9e", "Tous droits r\u00e9serv\u00e9s par quelqu'un dans une ann\u00e9e.", "Weiterlesen in einem anderen Artikel."]
    got = spark.createDataFrame([(x,) for x in lines], "l string").select("l", quality.line_fails(F.col("l")).alias("f")).collect()
    assert [r.l for r in got if not r.f] == [lines[0], *lines[6:11]] and all(r.f == brute.line_fails(r.l) for r in got)
    other = spark.createDataFrame([("Alles hier ist Reklame und nichts sonst.",)], "l string").select(quality.line_fails(F.col("l"), {"xx": ("reklame",)}).alias("f"))
    assert other.first().f


def test_pipeline_against_brute(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    step = {}
    cur = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, cur, sf_dir).cache()
        if name != "token_shards":
            assert out.columns == docs.columns
        step[name] = (cur, out)
        cur = out
    before, after = step["quality"]
    failed = {r.doc_id for r in before.collect() if brute.quality(r.text)[-1]}
    kept = {r.doc_id for r in after.collect()}
    assert not kept & failed
    good = docs.join(spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1"), "doc_id").collect()
    sound = [r.doc_id for r in good if not brute.quality(r.text)[-1]]
    assert len(kept & set(sound)) > 0.98 * len(sound)
    before, after = step["near_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, t in rows for w in [brute.WORD.findall(brute.lower(t))]}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    kept = [r.doc_id for r in after.collect()]
    assert sorted(kept) == sorted(set(kept)) and set(kept) <= set(sets)
    assert not [(a, b) for a in kept for b in kept if a < b and alike(a, b) >= 0.8]
    prints = {i: simhash.fingerprint(t.encode(), 5) for i, t in rows}
    near = lambda a, b: alike(a, b) >= 0.8 or (prints[a] ^ prints[b]).bit_count() <= 2
    assert all(any(near(a, b) for b in sets if b != a) for a in set(sets) - set(kept))
    before, after = step["decontaminate"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    hits = {r[0]: r for r in brute.decontaminate(rows, items)}
    texts = dict(rows)
    out = {r.doc_id: r.text for r in after.collect()}
    assert set(out) == {i for i, h in hits.items() if h[2] <= 0.5 * h[1]}
    assert all(len(brute.bench_words(out[i])) == hits[i][1] - hits[i][2] for i in out)
    assert all(out[i] == texts[i] for i in out if not hits[i][2])
    before, after = step["mix"]
    sizes = {r.doc_id: len(brute.WORD.findall(r.text)) for r in before.collect()}
    taken = {}
    for r in after.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(brute.WORD.findall(r.text))
    assert all(n <= 2 * sizes[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 2 * before.select("source").distinct().count()
    shard = step["token_shards"][1].agg(F.first("total_tokens")).first()[0]
    enc = shards.encoder()
    assert shard == sum(len(enc.encode_ordinary(r.text)) + 1 for r in step["mix"][1].collect())


@pytest.mark.parametrize("texts", [[], [None, None], ["too short", ""], ["same words here and there and on and on again today", None] * 2])
def test_pipeline_on_next_to_nothing(spark, tmp_path, texts):
    import corpus_pipeline

    docs = spark.createDataFrame([(k, t, None, "s" if k % 2 else None, None, "x") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, row string")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    kept = sum(brute.quality_kept(t)[0] for t in set(texts))
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == min(kept, 1)
