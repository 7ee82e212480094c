import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockline.llm import chat_format, decontaminate, license_scan, packing, quality, toxicity, url_filter
from tests.llm import brute


def test_decontamination_equals_brute_force(frame, corpus):
    words = (corpus[60] or "").split()
    items = [(1, " ".join(words[100:130])), (2, " ".join(words[500:510])), (3, " ".join(words[40:44])), (4, "one"), (5, ""), (6, None), (7, "absent " * 12),
             (1, " ".join(words[900:915])), (12, " ".join(words[105:125])), (None, "two")]
    items = [i for i in items if i[0] is not None]
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.find(frame(corpus.items()), frame(items, "item_id")).collect()}
    assert got == brute.contaminated(corpus, items)
    left = decontaminate.drop_contaminated(frame(corpus.items()), frame(items, "item_id"))
    assert {r["doc_id"] for r in left.collect()} == {d for d, v in brute.contaminated(corpus, items).items() if not v[4]}


def test_decontamination_of_odd_tables(frame):
    docs = frame([(1, "a b"), (1, "a b"), (1, "c"), (None, "a"), (None, "x b"), (2, None)])
    rows = decontaminate.find(docs, frame([], "item_id")).collect()
    assert len(rows) == 6 and not any(r["contaminated"] for r in rows)
    assert decontaminate.find(frame([]), frame([(1, "a")], "item_id")).count() == 0
    assert sum(r["contaminated"] for r in decontaminate.find(docs, frame([(1, "B")], "item_id")).collect()) == 3
    left = decontaminate.drop_contaminated(docs, frame([(1, "B"), (None, None)], "item_id"))  # each row by its own text
    assert sorted(str((r["doc_id"], r["text"])) for r in left.collect()) == ["(1, 'c')", "(2, None)", "(None, 'a')"]


def test_a_gram_of_very_many_items_costs_a_document_only_its_own_windows(frame, spark):
    common = "which of the following is true"
    items = [(i, f"{common} of u{i} v{i} w{i} x{i}") for i in range(400)]
    docs = {1: f"so {common} of u7 v7 w7 x7 then", 2: f"well {common} about nothing at all here now", 3: f"{common} of u9 v9 w9"}
    tests = decontaminate.item_windows(frame(items, "item_id"))
    rows, hits = decontaminate._met(frame(docs.items()), tests)
    found = {r["doc_id"]: r["count"] for r in rows.join(hits, "row_no").groupBy("doc_id").count().collect()}
    assert found == {1: 2, 3: 1}
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.find(frame(docs.items()), frame(items, "item_id")).collect()}
    assert got == brute.contaminated(docs, items)


def test_winnowing_keeps_a_hash_of_every_shared_window():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 2**63, 400, dtype=np.uint64)
    w = decontaminate.WINDOW - decontaminate.K + 1
    kept = set(decontaminate.winnow(grams, w).tolist())
    assert all(kept & set(grams[i : i + w].tolist()) for i in range(400 - w + 1)) and len(kept) < 200


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_packing_round_trip(frame, corpus, tokenizer, monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    docs = {**corpus, 200: "<|endoftext|> is one id,<|endoftext|><|endoftext|>too", 201: "<|endoftext|", 202: "a <|endoftext|>"}
    for shard in (1 << 21, 3000):
        monkeypatch.setattr(packing, "SHARD_TOKENS", shard)
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in packing.pack(frame(docs.items()), tokenizer).collect():
            pieces[r["doc_id"]].append(r)
            sequences[r["sequence_id"]].append(r)
        assert set(pieces) == set(docs)
        for doc, text in docs.items():
            ids, at = plain.encode(text or "", add_special_tokens=False).ids + [1], 0
            for r in sorted(pieces[doc], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids)
                assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
                at += r["length"]
            assert at == len(ids)
        for rows in sequences.values():
            at = 0
            for r in sorted(rows, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at == packing.LENGTH or at & (at - 1) == 0  # never padded
    assert packing.pack(frame([]), tokenizer).count() == 0


def test_packing_prefers_lexical_neighbours():
    rng = np.random.default_rng(3)
    docs = [np.concatenate((rng.integers(100 * (i % 4), 100 * (i % 4) + 100, 60), [1])).astype(np.uint16) for i in range(40)]
    index = packing.Index(docs, np.ones(50_257), 61.0)
    found = list(index.neighbours(0, np.arange(40) != 0))
    assert all(i % 4 == 0 for i in found[:9])


def test_packing_ranks_as_plain_bm25():
    """Rare and frequent terms, more neighbours than are sorted at first, copies that tie, used documents left out."""
    rng = np.random.default_rng(5)
    docs = [np.concatenate((rng.zipf(1.3, rng.integers(1, 90)) % 3_000 + 2, [1])).astype(np.uint16) for _ in range(220)]
    docs += docs[:30]
    frequency = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=50_257)
    idf, mean = np.log1p((len(docs) - frequency + 0.5) / (frequency + 0.5)), float(np.mean([len(d) for d in docs]))
    index = packing.Index(docs, idf, mean)
    assert 0 < len(index.rows) < len(np.unique(index.term))
    unused = rng.random(len(docs)) < 0.8
    for seed in range(0, len(docs), 7):
        scores = np.zeros(len(docs))
        for i, d in enumerate(docs):
            for t in np.intersect1d(d, docs[seed]):
                tf = (d == t).sum()
                scores[i] += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
        found = list(index.neighbours(seed, unused))
        assert sorted(found) == [i for i in np.flatnonzero(scores > 0).tolist() if unused[i]]
        assert np.allclose(scores[found], np.sort(scores[found])[::-1], rtol=1e-5)


def test_packing_asks_with_all_terms_of_a_seed():
    # Twenty rare terms of the seed stand nowhere else; the neighbour shares thirty light ones.
    rare, light = np.arange(1000, 1020), np.arange(2000, 2030)
    docs = [np.concatenate((rare, light, [1])), np.concatenate((np.arange(3000, 3050), [1])), np.concatenate((light, np.arange(4000, 4020), [1]))]
    idf = np.ones(50_257)
    idf[rare], idf[1] = 9.0, 0.01
    assert list(packing.Index([d.astype(np.uint16) for d in docs], idf, 51.0).neighbours(0, np.array([False, True, True]))) == [2, 1]


def test_packing_places_documents_by_content(frame, tokenizer, monkeypatch):
    rng = np.random.default_rng(8)
    topics = [[f"{a}{k}" for k in range(14)] for a in ("apple", "river", "stone", "cloud")]
    docs = {i: " ".join(topics[i % 4][k] for k in rng.permutation(14)) for i in range(1600)}  # a topic's documents never stand side by side
    monkeypatch.setattr(packing, "SHARD_TOKENS", 800)
    mixed = defaultdict(set)
    for r in packing.pack(frame(docs.items()), tokenizer).collect():
        mixed[r["sequence_id"]].add(r["doc_id"] % 4)
    assert np.mean([len(x) == 1 for x in mixed.values()]) > 0.6


def test_chat_round_trip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "\\", "\\|", "<\\|", "<<||", "a\nb\\n", "", None, "\U0001F600 <|x|>\r\n", "<|im_end|>\n"]
    rows = [(c, i, ("user", "assistant", "sys\ntem", None)[(i + c) % 4], t, "extra") for c in range(4) for i, t in enumerate(nasty)] + [(None, None, "assistant", "t", "extra"), (9, 0, "user", "u", "e"), (9, 0, "user", "u", "e")]
    turns = chat_format.turns_from_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string"))
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_turns(turns)).collect()}
    for conv in (0, 1, 2, 3, None, 9):
        own = [((r or ""), t or "") for c, _, r, t, _ in rows if c == conv]
        said = "".join(t for r, t in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own) and got[conv]["turns_sha256"] == brute.sha("".join(f"{r}\n{t}\n" for r, t in own))
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(said), brute.sha(said))
    assert chat_format.read_back(chat_format.format_turns(turns.limit(0))).count() == 0


def test_long_conversations_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "PART_CHARS", 500)
    turns = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", "w" * 100) for i in range(50)], chat_format._TURNS)
    parts = chat_format.format_turns(turns)
    assert parts.count() > 5 and chat_format.read_back(parts).first()["loss_chars"] == 2500


def test_layouts_are_known_by_fingerprint(spark):
    import json

    records = [{"prompt": "p", "completion": "c", "meta": 1}, {"instruction": "i", "input": "x", "output": "o"}, {"instruction": "i", "output": "o", "system": "s"},
               {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
               {"question": "q", "answer": "a"}, {"who": "knows"}, [1], None]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(20, "{broken"), (21, None)], "conv_id long, record string")
    got = defaultdict(list)
    for r in chat_format.turns_from_json(df).orderBy("conv_id", "turn").collect():
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert got == {0: [("user", "p"), ("assistant", "c")], 1: [("user", "i\n\nx"), ("assistant", "o")], 2: [("system", "s"), ("user", "i"), ("assistant", "o")],
                   3: [("user", "q"), ("assistant", "a")], 4: [("user", "q"), ("assistant", "a")], 5: [("user", "q"), ("assistant", "a")]}
    assert sorted(r["conv_id"] for r in chat_format.unmapped(df).collect()) == [6, 7, 8, 20, 21]
    with pytest.raises(ValueError):
        chat_format.turns_from_rows(df)


def test_license_scan(frame, corpus):
    docs = {**corpus, 300: "x Released under the MIT License.", 301: "MIT license, mit-license; Apache License", 302: "Licensed under CC BY-NC 4.0.",
            303: "you can redistribute it and or even modify it under the terms of the GNU General Public License as published", 304: "the GNU general public license",
            305: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", 306: "released under the released under the released under the"}
    got = {r["doc_id"]: r for r in license_scan.scan(frame(docs.items())).collect()}
    for doc, text in docs.items():
        w = brute.ALNUM.findall(brute.lower(text))
        at = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        assert tuple(got[doc])[1:6] == (len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))), doc
        assert set(got[doc]["base_labels"].split(",")) <= set(got[doc]["labels"].split(",")) | {""} and 0 <= got[doc]["score"] <= 1
    assert got[302]["labels"] == "cc-by-nc" and got[303]["labels"] == "gpl" and got[303]["score"] > 0.5 and got[301]["labels"] == "apache,mit" and got[304]["score"] == 0.5
    assert got[305]["labels"] == "cc-by-nc" and got[306]["labels"] == "" and got[306]["score"] == 0 and max(len(t.split()) for _, t, _ in license_scan.TEMPLATES) < 60
    assert license_scan.scan(frame([])).count() == 0
    assert license_scan.scan(frame([(1, "mit license"), (1, "mit license"), (None, None)])).count() == 3


def test_license_votes_belong_to_a_row_and_not_to_its_id(frame):
    """Halves of a notice in two texts of one id name no licence, nor does a notice without an id speak for others."""
    notice = "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
    w = notice.split()
    halves = [" ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :])]
    whole = {r["labels"] for r in license_scan.scan(frame([(7, notice)])).collect()}
    assert whole == {"apache"}
    parts = [" ".join(w[:9]), " ".join(w[9:])]
    alone = [license_scan.scan(frame([(7, p)])).collect()[0] for p in (*halves, *parts)]
    both = license_scan.scan(frame([(7, p) for p in (*halves, *parts)])).collect()
    assert sorted((r["n_words"], r["labels"], r["score"]) for r in alone) == sorted((r["n_words"], r["labels"], r["score"]) for r in both)
    rows = license_scan.scan(frame([(None, "Released under the MIT License"), (None, "nothing here at all to see"), (None, "nothing here at all to see")])).collect()
    assert sorted((r["labels"], r["score"]) for r in rows) == [("", 0.0), ("", 0.0), ("mit", 1.0)]


def test_url_rules_and_aliases(spark):
    link = '<head><LINK href="{}" rel="canonical"></head>'
    pages = [(1, "http://a.example.com/de/1", None), (2, "https://B.org/x?u=1", link.format("http://a.example.com/de/1/")), (3, "http://b.org/x.html#f", ""),
             (4, "http://b.org/fr/9", link.format("http://b.org/x")), (5, "http://c.io/y", link.format("/z")), (6, "http://c.io/z", '<meta http-equiv="refresh" content="0; url=http://d.net/q">'),
             (7, "http://d.net/q", None), (8, None, None), (9, "no scheme", None), (10, "http://net", None), (11, "http://x.net/", None), (12, "ftp://example.net/en/?q", None), (12, "ftp://example.net/en/?q", None),
             (13, "http://notexample.com/de/", None), (14, "http://e.io/é?x://y/", None)]
    got = defaultdict(list)
    for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect():
        got[r["page_id"]].append((r["host"], r["path"], r["rule"], r["verdict"]))
    block, allow = "block", "allow"
    assert got == {
        1: [("a.example.com", "/de/1", "example.com/de/", block)], 2: [("b.org", "/x", None, allow)], 3: [("b.org", "/x.html", None, allow)],
        4: [("b.org", "/fr/9", "org/fr/", allow)], 5: [("c.io", "/y", None, block)], 6: [("c.io", "/z", None, block)], 7: [("d.net", "/q", "net/", block)],
        8: [("", "", None, allow)], 9: [("", "", None, allow)], 10: [("net", "", None, allow)], 11: [("x.net", "/", "net/", block)],
        12: [("example.net", "/en/", "example.net/en/", allow)] * 2, 13: [("notexample.com", "/de/", None, allow)], 14: [("e.io", "/é", None, allow)]}
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    more = spark.createDataFrame([("http://e.io/é", "http://d.net/q")], "source string, target string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), redirects=more).collect()}[14] == block


@pytest.mark.parametrize("tag, target", [
    ('<link rel="canonical" href="z.html">', "/a/b/z"), ('<link rel="alternate canonical" href=../z>', "/a/z"), ("<link rel='canonical nofollow' href='./../../z/'>", "/z"),
    ('<link href="../../../z" rel=canonical>', "/z"), ('<meta http-equiv="refresh" content="3; url=z?u=http://x.io/">', "/a/b/z"), ('<link rel="canonical" href="//t.io/a/./z">', None),
    ('<link rel="canonical" href="mailto:z">', None), ('<link rel="canonicals" href="z">', None), ('<link rel="canonical" href="?p=2">', None), ('<link rel="canonical" href="#z">', None)])
def test_url_links_are_resolved_against_their_page(spark, tag, target):
    pages = spark.createDataFrame([("http://s.io/a/b/c.html?q=/x/y", tag)], "url string, html string")
    got = [tuple(r) for r in url_filter.page_links(pages).collect()]
    if "//t.io" in tag:
        assert got == [("s.io/a/b/c", "t.io/a/./z")]
    else:
        assert got == ([("s.io/a/b/c", "s.io" + target)] if target else [])


def test_url_rules_of_one_host_meet_by_path(spark):
    """Ten thousand rules of one host: a page meets only those whose paths begin its own."""
    rules = spark.range(10_000).select(F.lit("block").alias("r_verdict"), F.lit("big.io").alias("r_host"), F.concat(F.lit("/r"), F.col("id").cast("string")).alias("r_path"))
    rules = rules.unionByName(spark.createDataFrame([("allow", "big.io", "/r12/ok"), ("allow", "big.io", "")], rules.schema))
    pages = spark.createDataFrame([(i, f"http://{'www.' * (i % 2)}big.io/r{i}/{'ok' * (i == 12)}", None) for i in (12, 13, 123_456, 99_999_999)] + [(1, "http://big.io/x", None), (2, "http://o.io/r1", None)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()}
    assert got == {12: ("big.io/r12/ok", "allow"), 13: ("big.io/r13", "block"), 123_456: ("big.io/r1234", "block"), 99_999_999: ("big.io/r9999", "block"),
                   1: ("big.io", "allow"), 2: (None, "allow")}


def _labelled(frame, spark, module, make):
    rng = np.random.default_rng(6)
    texts, labels = zip(*(make(rng, i) for i in range(400)))
    docs = frame([*enumerate(texts), (1000, None), (1001, ""), (None, "x"), (3, texts[3])])
    table = spark.createDataFrame([(i, int(y), int(y), "z") for i, y in enumerate(labels)] + [(3, int(labels[3]), int(labels[3]), "z"), (None, 1, 1, "z"), (5000, 1, 1, "z"), (7, None, None, "z")], "doc_id long, quality int, toxic int, text string")
    held = F.col("doc_id") % 4 == 0
    rows = module.score(docs, table, ~held).collect()
    assert len(rows) == 404 and all(0 <= r["score"] <= 1 for r in rows)
    right = [(r["score"] >= 0.5) == bool(labels[r["doc_id"]]) for r in rows if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 4 == 0]
    assert np.mean(right) > 0.9
    for empty in (table.limit(0), table.where("toxic = 1")):
        assert module.score(docs, empty, ~held).count() == 404
    assert module.score(docs.limit(0), table, ~held).count() == 0


def test_toxicity_learns_pairs_that_single_words_do_not_show(frame, spark):
    def make(rng, i):
        insult, group = rng.random(2) < 0.5
        words = [f"w{k}" for k in rng.integers(0, 30, 12)]
        return " ".join(words + (["insult"] if insult else ["praise"]) + (["group"] if group else ["nobody"])), insult == group

    _labelled(frame, spark, toxicity, make)


def test_toxicity_learns_pairs_among_thousands_of_words(frame, spark):
    """80 words, each neutral alone and less frequent than many others: which half of the one forty meets which half of the other decides."""
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(8_000):
        a, b = rng.integers(0, 40, 2)
        rows.append((i, " ".join([f"w{int(3_000**u)}" for u in rng.random(20)] + [f"one{a}", f"two{b}"])))
        labels.append((i, int((a < 20) == (b < 20))))
    scored = toxicity.score(frame(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), toxicity.F.col("doc_id") % 4 != 2)
    held = {r["doc_id"]: r["score"] for r in scored.collect() if r["doc_id"] % 4 == 2}
    one, none = ([s for i, s in held.items() if labels[i][1] == k] for k in (1, 0))
    auc = np.mean(np.array(one)[:, None] > np.array(none)[None, :])
    assert auc > 0.95, auc


def test_toxic_rows_are_dropped_by_their_own_text(frame, spark):
    rows = [(i, "vile insult" if i % 2 else "kind praise") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    rows = frame([*rows, (None, "vile insult"), (None, "kind praise"), (4, "vile insult")])
    left = toxicity.drop_toxic(rows, labels, toxicity.F.col("doc_id") % 4 > 1)
    assert left.columns == rows.columns
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert len(got) == 101 and {t for _, t in got} == {"kind praise"} and (None, "kind praise") in got and (4, "kind praise") in got


def test_quality(frame, spark):
    def make(rng, i):
        words = [f"w{k}" for k in rng.integers(0, 60, 30)]
        return (" ".join(words), True) if i % 2 else (" | ".join(words), False)

    _labelled(frame, spark, quality, make)
