"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from noema.llm import byte_bpe, ctw, decontaminate, html_text, license_scan, lm_score, media, progressive_jpeg, quality, simhash, substring_dedup, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, key long, fp string"
RNG = random.Random(5)
WORDS = [f"w{k}" for k in range(400)] + ["Été", "日本", "Ω", "don't", "***"]


def prose(n: int) -> str:
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def make_texts() -> list[str | None]:
    base = [prose(60) for _ in range(12)]
    passage = prose(45)
    out: list[str | None] = [None, "", " \n ", "one", "a a a a", "x " * 300, prose(9000)]
    out += base + base[:4] + base[:1] * 6
    out += [b.replace("w1", "W1", 1) + " tail" for b in base[:3]]
    out += [f"{prose(20)} {passage} {prose(20)}" for _ in range(5)]
    out += ["the same ten words " * 40, "\x00nul\x0bvt\x0cff nbsp em <|endoftext|> '’s"]
    return out


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k != 3 else None, t, "en", "s", None if t is None else len(t), "h", k, "f") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[-1]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_counts(docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = token_counts.token_counts(docs, path).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        text = TEXTS[3 if r["doc_id"] is None else r["doc_id"]] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)
    assert token_counts.token_counts(nothing, path).count() == 0


def test_byte_bpe(docs, nothing):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    for k, r in by_id(byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN)).items():
        text = TEXTS[3 if k is None else k] or ""
        ids = library.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN), path)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {None if k == 3 else k: t or "" for k, t in enumerate(TEXTS)}
    assert byte_bpe.round_trip(nothing, path, public_tokenizers.PATTERN).count() == 0


def test_transducer_on_random_bytes():
    machine = byte_bpe.Transducer(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    for n in (1, 2, 7, 90, 300):
        for _ in range(20):
            piece = bytes(RNG.choice(b"abcde \xc3\xa9\xe2tionhe") for _ in range(n))
            assert list(machine.encode_piece(piece)) == machine.by_merging(piece)


def test_utf8_stream_over_any_cut():
    data = "aé日😀z".encode()
    for k in range(len(data)):
        stream = byte_bpe.Utf8Stream()
        assert stream.feed(data[:k]) + stream.feed(data[k:]) + stream.close() == "aé日😀z"


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST, 0])
def test_decontamination(spark, docs, nothing, broadcast):
    clean = [t for t in TEXTS if t and len(t.split()) == 60]
    items = [(1, " ".join(clean[0].split()[5:25])), (2, clean[1].upper()), (3, "w7 w9"), (4, None), (5, ""), (6, "never there at all in any of these texts my friend"), (1, "other text of the same id"), (7, "x x x"), (None, " ".join(clean[2].split()[:12]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    for k, r in by_id(decontaminate.contamination(docs, table, broadcast=broadcast)).items():
        n, hit, names = decontaminate.brute_force(TEXTS[3 if k is None else k], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(names), hit > 0), k
        assert r["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
    assert decontaminate.contamination(docs, table, broadcast=broadcast).count() == len(TEXTS) + 1
    assert decontaminate.contamination(nothing, table).count() == 0
    assert decontaminate.contamination(docs, table.limit(0)).where("contaminated").count() == 0
    left = {r["doc_id"] for r in decontaminate.clean(docs, table, broadcast=broadcast).collect()}
    assert left == {None if k == 3 else k for k, t in enumerate(TEXTS) if not decontaminate.brute_force(t, items)[1]}


def test_substring_dedup(docs, nothing):
    want = substring_dedup.brute_force([*TEXTS, TEXTS[-1]])
    for hot in (substring_dedup.HOT, 1):  # also with every key dealt out by window
        got = substring_dedup.dedup(docs, hot_from=hot).collect()
        assert len(got) == len(want)
        for r in got:
            k = 3 if r["doc_id"] is None else r["doc_id"]
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[k], k
    assert substring_dedup.dedup(nothing).count() == 0
    rewritten = by_id(substring_dedup.rewrite(docs))
    for k, r in rewritten.items():
        text = TEXTS[3 if k is None else k]
        assert r["hash"] == "h" and (text is None) == (r["text"] is None)
        if text is not None:
            assert r["n_chars"] == len(r["text"]) and (r["text"] == text) == (want[3 if k is None else k][1] == 0)


@pytest.mark.parametrize(("crowd", "blocks"), [(4096, 3), (1, 3), (4096, 2)])
def test_simhash(docs, nothing, crowd, blocks):
    ids = [None if k == 3 else k for k in range(len(TEXTS))]
    prints, label = simhash.brute_force(TEXTS)
    lowest = {}
    for k, name in enumerate(label):
        if ids[k] is not None:
            lowest[name] = min(lowest.get(name, k), k)
    got = simhash.near_duplicates(docs, crowd=crowd, blocks=blocks).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        k = 3 if r["doc_id"] is None else r["doc_id"]
        assert (r["fingerprint"], r["component_id"]) == (f"{prints[k]:016x}", lowest.get(label[k])), k
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.representatives(docs, crowd=crowd, blocks=blocks).collect()
    assert len(kept) == len(set(label)) and {r["doc_id"] for r in kept} == {lowest.get(x) for x in set(label)}


def test_anchors_find_every_close_pair():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    for blocks in (2, 3):
        cover = simhash.Cover(4, blocks)
        b = a.copy()
        for _ in range(4):
            b ^= np.uint64(1) << rng.integers(0, 64, len(b)).astype(np.uint64)
        met = np.zeros(len(a), bool)
        for block in range(len(cover.parts)):
            row, key = cover.near(b, block)
            home = cover.home(a, block)
            met[np.unique(row[home[row] == key])] = True
        assert met.all()


def test_lm_scores(docs, nothing):
    every = [*TEXTS, TEXTS[-1]]
    ids = ["" if k == 3 else str(k) for k in range(len(TEXTS))] + [str(len(TEXTS) - 1)]
    train = [(t or "").encode() for t, i in zip(every, ids, strict=True) if zlib.crc32(i.encode()) % 10]
    counts: dict[bytes | None, int] = {}
    for t in train:
        for w in [*t.lower().split(), None]:
            counts[w] = counts.get(w, 0) + 1
    total, floor = sum(counts.values()), sum(counts.values()) + 0.1 * (len(counts) + 1)
    keys, n = np.unique(ctw.gram_keys(train, 6), return_counts=True)
    tree = ctw.Tree(keys, n, 6)
    got = lm_score.score(docs).collect()
    assert len(got) == len(every)
    for r in got:
        k = 3 if r["doc_id"] is None else r["doc_id"]
        data = (TEXTS[k] or "").encode()
        tokens = [*data.lower().split(), None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(ids[k].encode()) % 10 == 0, len(tokens), sum(w in counts for w in tokens), total)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts.get(w, 0) + 0.1) / floor) for w in tokens))
        assert r["score"] == pytest.approx(tree.log_probability(ctw.gram_keys([data], 6)).sum() / np.log(10), rel=1e-4)
    assert lm_score.score(nothing).count() == 0


def test_ctw_sums_to_one_and_matches_its_definition():
    keys, n = np.unique(ctw.gram_keys([b"abracadabra", b"abba"], 2), return_counts=True)
    tree = ctw.Tree(keys, n, 2)
    for context in (b"\xff\xff", b"ab", b"zz"):
        grams = np.array([context[1] << 16 | context[0] << 8 | x for x in range(256)], np.uint64)
        assert np.exp(tree.log_probability(grams)).sum() == pytest.approx(1.0)
    split = ctw.Tree(keys, n, 2, 1)
    short, total = ctw.shorter(*split.entries)
    below = [(np.unique(k), np.bincount(np.unique(k, return_inverse=True)[1], v)) for k, v in split.upward]
    above = ctw.Tree(short, total, 0, 0, below)
    assert split.log_probability(keys, above) == pytest.approx(tree.log_probability(keys))


def test_quality(spark, docs, nothing):
    good, bad = [prose(80) + "." for _ in range(150)], ["!!! " + " ".join(RNG.choice(WORDS).upper() + "!!" for _ in range(80)) for _ in range(150)]
    rows = [(k, t, "en", "s", len(t), "h", k, "f") for k, t in enumerate(x for pair in zip(good, bad, strict=True) for x in pair)]
    table = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(len(rows))] + [(0, 1, 0), (2, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(table, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 300 and len(held) > 30
    assert np.mean([r["predicted"] == 1 - r["doc_id"] % 2 for r in held]) > 0.97
    model = quality.train(table, labels)
    scored = quality.score(docs, model).collect()
    assert len(scored) == len(TEXTS) + 1 and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.accepted(docs, model).columns == docs.columns
    assert quality.accepted(docs, model).count() == sum(r["predicted"] for r in scored)
    assert quality.classify(nothing, labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).where("predicted = 1").count() == len(TEXTS) + 1


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    model = quality.Model(0.3, rng.normal(size=quality.WIDTH).astype(np.float32), rng.normal(size=(quality.WIDTH, 3)).astype(np.float32))
    rows = quality.features([b"a few words here here"], np.array([21]))
    x = list(zip(rows.index.tolist(), rows.value.tolist(), strict=True))
    want = 0.3 + sum(model.linear[i] * v for i, v in x) + sum(model.factors[i] @ model.factors[j] * v * w for n, (i, v) in enumerate(x) for j, w in x[n + 1 :])
    assert model.raw(rows)[0] == pytest.approx(want, rel=1e-3)


def test_media(docs, nothing):
    for r in media.media_column(docs, keep=True).collect():
        data = (TEXTS[3 if r["doc_id"] is None else r["doc_id"]] or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert len(r["rgb"]) == r["height"] * r["width"] * 3
    assert media.media_column(nothing).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_jpeg_round_trip(share):
    rng = np.random.default_rng(4)
    across, down = progressive_jpeg.layout(np.array([1, 3, 8]))
    coefficients = rng.integers(-128, 128, (int((across * down).sum()) * 6, 64))
    coefficients[rng.random(coefficients.shape) < share] = 0
    back = progressive_jpeg.decode(progressive_jpeg.encode(coefficients, across, down))
    assert (back[0] == coefficients).all() and (back[1] == across).all()


def test_inverse_transform_by_definition():
    coefficients = np.zeros((6, 64), np.int64)
    coefficients[:4, 0], coefficients[4, 0], coefficients[5, 0] = 80, 40, -24
    rgb = progressive_jpeg.units_rgb(coefficients, [np.ones(64, np.float32)] * 3)
    y, cb, cr = 138, 5, -3
    assert (rgb == np.rint([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb])).all()


def test_main_text(spark):
    shell = '<html><head><title>t</title><script>x="</p>"</script></head><body><nav><a href="/">menu</a></nav><div class="ad">buy</div>{}<div id="comments"><p>reader</p></div><footer>&copy; me</footer></body></html>'
    pages = [shell.format(f"<article><h1>Head {k}</h1><p>Text &amp; more\n {k}<p>Second <b>bold</b>er</article>") for k in range(5)]
    rows = [(k, f"http://h.example/{k}", p) for k, p in enumerate(pages)] + [(9, None, None), (10, "x", ""), (11, "http://h.example/0", pages[0]), (12, "http://o.example/", "<p>a < b<p>c<form>no</form>")]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(5)] == [f"Head {k}\nText & more {k}\nSecond bolder" for k in range(5)]
    assert (got[9], got[10], got[11], got[12]) == ("", "", got[0], "a < b\nc")


def test_template_leaves_out_constant_texts():
    pages = [f"<body><div class=x><p>Read this first</p><p>Sold in all shops</p></div><div class=y><p>own words {k} {k * 7}</p></div></body>" for k in range(6)]
    template = html_text.brute_force(pages)
    assert [html_text.article(html_text.tokens(p), template) for p in pages] == [f"own words {k} {k * 7}" for k in range(6)]


def test_license_scan(spark):
    rows = [(1, "a/LICENSE", "The MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (2, "a/b/x.py", "code"), (3, "a/b/y.py", "text. Licensed under the Apache License, Version 2.0. More"), (4, "z.py", "mit dem der"), (5, "a/b/COPYING", "GNU General Public License Version 3, 29 June 2007"), (6, "a/c.py", None), (7, None, "plain"), (2, "a/b/x.py", "code")]
    got = [(r["doc_id"], r["license"], r["inherited"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, "MIT", False), (2, "GPL-3.0", True), (2, "GPL-3.0", True), (3, "Apache-2.0", False), (4, None, False), (5, "GPL-3.0", False), (6, "MIT", True), (7, None, False)], key=str)
