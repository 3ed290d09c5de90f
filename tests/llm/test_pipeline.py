from __future__ import annotations

import re

import numpy as np
import public_tokenizers

import corpus_pipeline
from tillpath.llm import exact_dedup, packing, quality_rules, secrets, simhash
from tillpath.llm.text_features import vector
from tillpath.llm.tokens import library_tokenizer


def mask(text, spans):
    out, at = "", 0
    for span in spans.split(","):
        _, a, b = span.split(":")
        if int(a) >= at:
            out += text[at : int(a)] + "[SECRET]"
        at = max(at, int(b))
    return out + text[at:]


def test_pipeline_equals_a_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    # 1: the stage's own model, applied text by text
    model = quality_rules.train(docs, labels)
    left = []
    for r in docs.collect():
        data = r.text.encode()
        n, *_, repeated = quality_rules.counts(data, data.split())
        if n >= 50 and 100 * repeated <= 50 * n and model.probability(vector(data)[None])[0] >= quality_rules.MIN_QUALITY:
            left.append(r)
    assert 0 < len(left) < docs.count()
    # 2: equal texts
    best = {}
    for r in left:
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        best[key] = min(best.get(key, (0, 1 << 60)), (-len(r.text), r.doc_id))
    ids = {doc for _, doc in best.values()}
    left = [r for r in left if r.doc_id in ids]
    # 3: components of fingerprints, smallest doc_id first
    prints = {r.doc_id: np.uint64(simhash.fingerprint(r.text.encode())) for r in left}
    group = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if bin(int(prints[a] ^ prints[b])).count("1") <= 3 and group[a] < group[b]:
                    group[b], changed = group[a], True
    left = [r for r in left if group[r.doc_id] == r.doc_id]
    # 4: secrets
    frame = spark.createDataFrame(left, docs.schema)
    spans = {r.doc_id: r.spans for r in secrets.scan(frame).collect()}
    texts = {r.doc_id: mask(r.text, spans[r.doc_id]) if spans[r.doc_id] else r.text for r in left}
    # 5: lengths of the packed pieces
    library = library_tokenizer(public_tokenizers.path(packing.VOCABULARY))
    want = {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items()}
    got = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_stages_return_documents_and_survive_odd_rows(spark, odd_docs):
    folder = "/root/testdata/sf0.001"
    for table in (odd_docs, odd_docs.limit(0)):
        docs = table
        for name, step in corpus_pipeline.STAGES[1:]:
            docs = step(spark, docs, folder)
            if name != "best_fit_packing":
                assert docs.columns == table.columns
        docs.count()


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def contents(spark, step, rows):
    docs = spark.createDataFrame(rows, DOCUMENTS)
    return sorted(((r.doc_id, r.text) for r in step(docs).collect()), key=repr)


def test_null_and_repeated_ids_get_their_own_decision(spark):
    words = [" ".join(f"w{(i * k * k + 7 * i) % 997}" for i in range(1, 40)) for k in range(4)]
    plain = lambda doc, text: (doc, text, "en", "s", len(text))
    # A unique text under the id of a copy; a whole row twice; copies without an id.
    pairs = [(7, words[0]), (7, words[1]), (3, words[1]), (5, words[2]), (5, words[2]), (None, words[3]), (None, words[3]), (None, words[1])]
    want = sorted([(7, words[0]), (3, words[1]), (5, words[2]), (None, words[3])], key=repr)
    rows = [plain(*p) for p in pairs]
    assert contents(spark, exact_dedup.drop_copies, rows) == want
    assert contents(spark, simhash.drop_near_copies, rows) == want
    secret = ["token=" + c * 30 for c in "abc"]
    rows = [plain(None, f"x {secret[0]} y"), plain(4, f"{secret[1]} tail"), plain(4, f"long head {secret[2]}"), plain(4, "clean text of the same id")]
    assert contents(spark, secrets.redact, rows) == sorted(
        [(None, "x [SECRET] y"), (4, "[SECRET] tail"), (4, "long head [SECRET]"), (4, "clean text of the same id")], key=repr
    )


def test_odd_rows_keep_their_texts(spark, odd_docs):
    keys = lambda rows: sorted(re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in rows)
    once = exact_dedup.drop_copies(odd_docs.unionByName(odd_docs)).collect()
    assert keys(once) == sorted({*keys(odd_docs.collect())})
    assert sum(r.doc_id == 11 for r in once) == 2
    masked = secrets.redact(odd_docs).collect()
    assert sorted(map(repr, masked)) == sorted(map(repr, odd_docs.collect()))


CLASHES = ("_row_key", "_spans", "_row", "key", "doc", "spans", "tokens", "base", "live", "verdicts", "fp", "name", "level", "value_hash")


def test_clashing_columns_come_through_unchanged(spark):
    """With any column of the operators' own names the rows are those without it, and the column keeps its values."""
    secret = ["token=" + c * 30 for c in "abc"]
    texts = [f"x {s} y {i} " + " ".join(f"w{(i * k * k) % 97}" for k in range(40)) for i, s in enumerate(secret)] * 2
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    wide = docs
    for number, name in enumerate(CLASHES):
        wide = wide.withColumn(name, (docs["doc_id"] * 0 + 5 + number).cast("long"))
    for _, step in corpus_pipeline.STAGES[1:4]:
        plain, got = step(spark, docs, ""), step(spark, wide, "")
        assert got.columns == wide.columns
        assert sorted(map(tuple, got.select(docs.columns).collect())) == sorted(map(tuple, plain.collect()))
        assert {tuple(r) for r in got.select(*CLASHES).collect()} == {tuple(range(5, 5 + len(CLASHES)))}
    spans = lambda df: sorted(map(tuple, secrets.scan(df).collect()))
    assert spans(wide) == spans(docs)


def test_a_run_keeps_only_the_results_of_its_stages(spark):
    import os

    from tillpath.session import shared_folder

    top = os.path.dirname(shared_folder(spark).removeprefix("file:"))
    corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    assert not [d for d in os.listdir(top) if d.startswith("scope-")]
