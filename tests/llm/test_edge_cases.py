"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import random
import re

import public_tokenizers
import pytest

from steplens.llm import ann, chat, fingerprints, html_extract, line_dedup, packing, quality, sentencepiece_codec, simhash, substring_dedup

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
KINDS = "doc_id long, text string, lang string, source string, n_chars long, key long, at int, n int, fp string, spans string, score string, r int, part int, place string, chunk string, h1 string, first string, x string"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "Delta", "été", "一二", "é", "x y"]
    long_text = " ".join(rng.choice(words) + str(rng.randrange(3000)) for _ in range(30000))
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \n\t ", "one", "two words", passage, "lead in " + passage + " and out", passage, long_text, "line a\nline b\nline c\n" * 40, "x" * 20000, "<|endoftext|> ▁ \\ </turn> \x1c\x85", "A\r\nB", "😀 " * 50]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (None, None), (3, "one"), (3, "one"), (4, "other text of a repeated id"), (-(1 << 62), "far"), ((1 << 62), "far")]
    extra = ("en", "s", 1, 5, 6, 7, "f", "g", "h", 8, 9, "p", "c", "q", "z", "y")
    return spark.createDataFrame([(i, t, *extra) for i, t in rows], KINDS)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


LABELS = "doc_id long, quality int, toxic int"


def operators(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (6, 1, None), (8, None, 1), (None, 1, 0), (11, 0, 0)], LABELS)
    return {
        "encode": lambda d: sentencepiece_codec.encode_documents(d, PIECES),
        "pack": lambda d: packing.pack_documents(d, WORDS),
        "quality": lambda d: quality.score_documents(d, labels),
        "lines": line_dedup.dedup_lines,
        "windows": substring_dedup.remove_repeats,
        "fingerprints": fingerprints.fingerprints,
        "simhash": simhash.near_duplicates,
        "keep_one": simhash.keep_one,
    }


NAMES = ["encode", "pack", "quality", "lines", "windows", "fingerprints", "simhash", "keep_one"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, none, name):
    assert operators(spark)[name](none).collect() == []


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ("pack", "keep_one")])
def test_one_row_for_each_row(spark, odd, name):
    got = operators(spark)[name](odd).select("doc_id").collect()
    assert sorted(str(r[0]) for r in got) == sorted(str(r[0]) for r in odd.select("doc_id").collect())


def test_columns_pass_through(odd):
    for op in (line_dedup.dedup_lines, substring_dedup.remove_repeats):
        out = op(odd)
        assert out.columns[: len(odd.columns)] == odd.columns and {r["spans"] for r in out.collect()} == {"g"}
    assert simhash.keep_one(odd).columns == odd.columns


def test_null_text_stays_null(odd):
    for op in (line_dedup.dedup_lines, substring_dedup.remove_repeats):
        assert {r["text"] for r in op(odd).where("doc_id = 0").collect()} == {None}


def test_sentencepiece_round_trip(odd):
    coded = sentencepiece_codec.encode_documents(odd, PIECES)
    flags = {(r["doc_id"], r["round_trip"]) for r in coded.collect()}
    assert {i for i, ok in flags if not ok} == {11}
    texts = {r["doc_id"]: r["text"] for r in odd.where("doc_id between 0 and 10 and doc_id not in (3, 4)").collect()}
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode_documents(coded, PIECES).collect()}
    assert all(back[i] == (t or "") for i, t in texts.items())


def test_sentencepiece_against_the_library(tmp_path):
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(PIECES, "rb").read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        p.score = max(p.score, -31000.0)  # sums stay exact in single precision
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    theirs, ours = SentencePieceProcessor(model_file=str(path)), sentencepiece_codec.Codec(str(path))
    rng = random.Random(2)
    texts = ["", "the", "hello  world", " a", "b ", "naïve 日本 😀 x", "tab\there"] + ["".join(rng.choice("the anorus,.Ü ") for _ in range(rng.randrange(40))) for _ in range(300)]
    ids, ends = ours.encode(texts)
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == theirs.encode(t), t


def test_packing_against_the_tokenizer(odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    rows = packing.pack_documents(odd, WORDS, with_ids=True).collect()
    want = sorted(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in odd.collect())
    by_doc, got, open_ = {}, [], {}
    for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["ids_crc32"] if r["start"] == 0 else 0)):
        assert len(r["ids"]) == r["length"] <= 2048
        by_doc.setdefault(r["doc_id"], []).append(r)
        open_.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    single = [r for v in by_doc.values() if all(x["piece"] == 0 for x in v) for r in v]
    got = [r["ids"] for r in single] + [sum((r["ids"] for r in sorted(v, key=lambda r: r["piece"])), []) for v in by_doc.values() if any(x["piece"] for x in v)]
    assert sorted(got) == want
    for spans in open_.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 2048
    ids = {r["sequence_id"]: r["ids"] for r in packing.sequences(packing.pack_documents(odd, WORDS, with_ids=True)).collect()}
    assert {k: len(v) for k, v in ids.items()} == {k: sum(n for _, n in v) for k, v in open_.items()}


def test_capacity_tree_is_best_fit():
    import numpy as np

    rng = random.Random(3)
    for _ in range(100):
        capacity = rng.choice([1, 2, 7, 16, 100])
        lengths = np.array([rng.randint(1, capacity) for _ in range(rng.randrange(50))], np.int64)
        bins, offsets = packing.best_fit_decreasing(lengths, capacity)
        left = []
        for i in np.argsort(-lengths, kind="stable"):
            fits = [r for r in left if r >= lengths[i]]
            if fits:
                left[left.index(min(fits))] -= lengths[i]
            else:
                left.append(capacity - lengths[i])
        assert sorted(capacity - lengths[bins == b].sum() for b in range(len(left))) == sorted(left)


def test_windows_against_brute_force(spark):
    rng = random.Random(4)
    base = [f"v{rng.randrange(50)}" for _ in range(400)]
    texts = []
    for _ in range(25):
        a, n = rng.randrange(300), rng.randrange(0, 90)
        texts.append(rng.choice([" ", "\n", "  "]).join([f"u{rng.random()}" for _ in range(rng.randrange(5))] + base[a : a + n] + ["end"] * rng.randrange(3)))
    texts += ["same " * 50, None, texts[0]]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - 34):
            seen.setdefault(tuple(w[i : i + 35]), []).append((d, i))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d] |= set(range(i, i + 35))
    got = substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in got.collect():
        w, g = words[r["doc_id"]], gone[r["doc_id"]]
        assert (r["n_words"], r["n_removed"]) == (len(w), len(g))
        assert re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") == [x for i, x in enumerate(w) if i not in g]
        assert g or r["text"] == texts[r["doc_id"]]


def test_lines_keep_the_first_place_and_survive_shifts(spark):
    block = "\n".join(f"common line {i}" for i in range(400))
    docs = spark.createDataFrame([(2, "intro\n" + block + "\noutro"), (1, block), (3, "a\nb\n" + block), (4, "single\n\n\n"), (5, "single\n\n\n")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1]["text"] == block and got[1]["n_removed"] == 0
    for i in (2, 3):
        assert got[i]["n_removed"] >= 340 and got[i]["n_lines"] - got[i]["n_removed"] == len(got[i]["text"].split("\n"))
    assert got[2]["text"].startswith("intro") and got[2]["text"].endswith("outro")


def test_simhash_links_against_brute_force(spark):
    import numpy as np

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = list(dict.fromkeys(b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(7))) for b in base for _ in range(12)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")

    def groups(pairs):
        parent = {s: s for s in signed}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[root(a)] = root(b)
        out = {}
        for s in signed:
            out.setdefault(root(s), set()).add(s)
        return sorted(map(sorted, out.values()))

    a = np.array(fps, np.uint64)
    want = groups((signed[i], signed[j]) for i, j in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 4), strict=True))
    for part in (8192, 7):  # the second deals keys out as grids
        got = simhash.links(df, len(fps), part=part).collect()
        assert groups((r["u"], r["v"]) for r in got) == want
        assert all(bin((r["u"] ^ r["v"]) & (1 << 64) - 1).count("1") for r in got)


def test_fingerprints_fold(spark):
    same = ["Ｆｏｏ  Bar", "foo bar", " FOO\n BAR "]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*same, "foo  baz", "Straße", "STRASSE", "é", "é"])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    assert len({got[i]["fingerprint"] for i in range(3)}) == 1 and got[3]["fingerprint"] != got[0]["fingerprint"]
    assert got[4]["fingerprint"] == got[5]["fingerprint"] and got[6]["fingerprint"] == got[7]["fingerprint"]
    assert got[2]["near_next"] == 1.0 and got[3]["near_next"] == 0.0 and got[0]["near_next"] == 0.0


@pytest.mark.parametrize("width", [0, 1])
def test_shared_digests_are_told_apart(spark, width):
    """With digests of no or one character nearly all are shared: rows of one doc_id, equal texts and edited ones still agree."""
    rows = [(1, "a"), (2, "b"), (3, "b"), (4, None), (5, "one"), (5, "two"), (5, "ONE"), (None, "two")] + [(i, "xyz"[i % 3] * 9) for i in range(10, 22)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    short = fingerprints.fingerprints(docs, digest=lambda folded: fingerprints.digest(folded)[:width]).collect()
    real = fingerprints.fingerprints(docs).collect()
    by = {str((r["doc_id"], r["edited_sha256"])): r for r in real}
    assert len(by) == len({str((r["doc_id"], r["edited_sha256"])) for r in short}) and len(short) == len(rows)
    names, back = {}, {}
    for r in short:
        other = by[str((r["doc_id"], r["edited_sha256"]))]
        for c in ("fingerprint", "edited_fingerprint"):
            assert names.setdefault(other[c], r[c]) == r[c] and back.setdefault(r[c], other[c]) == other[c]
    assert any("-" in n for n in back)


def test_one_doc_id_for_all_rows(spark):
    docs = spark.createDataFrame([(7, t) for t in ["b", "a", "a", None, "c" * 9]], "doc_id long, text string")
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == 5 and {r["doc_id"] for r in got} == {7} and len({r["fingerprint"] for r in got}) == 4
    ordered = ["", "a", "a", "b", "c" * 9]  # rows of one doc_id stand in the order of their texts
    edited = {t[: len(t) - len(t) // 3] + after[: len(t) // 3] for t, after in zip(ordered, [*ordered[1:], ordered[0]], strict=True)}
    import hashlib

    assert {r["edited_sha256"] for r in got} == {hashlib.sha256(t.encode()).hexdigest() for t in edited}


def test_near_edited_and_edited_fingerprints(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    for i, r in enumerate(docs):
        after, third = docs[(i + 1) % len(docs)]["text"], len(r["text"]) // 3
        edited, own = fingerprints.canonical(r["text"][: len(r["text"]) - third] + after[:third]), fingerprints.canonical(r["text"])
        found = got[r["doc_id"]]
        assert (found["near_edited"], found["near_next"]) == (float(edited == own), float(own == fingerprints.canonical(after)))
        assert (found["fingerprint"] == found["edited_fingerprint"]) == (edited == own) and found["edited_fingerprint"] == fingerprints.digest(edited)


def test_learned_text_of_many_turns(spark):
    import time

    from pyspark.sql import functions as F

    def least(n):
        rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} \\ </turn> ###" if i % 7 == 0 else f"turn {i}, é") for i in range(n)]
        read = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).withColumn("mask", chat.loss_mask())
        read = read.withColumn("learned", chat.learned_text()).select("learned").cache()
        assert read.first()[0] == "".join(t for _, _, role, t in rows if role == "assistant")
        read.unpersist()
        formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).withColumn("mask", chat.loss_mask()).cache()
        formatted.count()
        times = []
        for k in range(3):
            began = time.perf_counter()
            formatted.select(F.length(chat.learned_text()).alias(f"n{k}")).collect()
            times.append(time.perf_counter() - began)
        formatted.unpersist()
        return min(times)

    for n in (0, 1, 255, 256, 257, 513):
        if n:
            least(n)
    assert least(32_000) < 16 * max(least(4_000), 0.05)  # 8 is in proportion, 64 the square


def test_neighbours_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    x[100:300] = x[100]  # ties
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(5000, None, 1), (5020, [0.0] * 12, 1), (5040, [float("nan")] * 12, 1), (5060, [None] * 12, 1), (5080, [1.0], 1), (None, [1.0] * 12, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf int")
    got = ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), part=64).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(by) == list(range(0, 900, 20))
    d, hits = x.astype(np.float64), 0
    for q, found in by.items():
        s = d @ d[q]
        best = sorted((-v, i) for i, v in enumerate(s) if i != q)[:20]
        assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(abs(v - s[i]) < 1e-12 for i, v in found)
        hits += len({i for _, i in best} & {i for i, _ in found})
    assert hits / (20 * len(by)) >= 0.9
    assert ann.nearest(vectors.limit(0), vectors.limit(0)).collect() == []
    few = vectors.where("vec_id < 5")
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 4


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site name</h1></header>
<nav><ul><li><a href="/a">Home, news, and more</a></li></ul></nav><div class="cookie-notice">We use cookies, as you know, on this site.</div>
<div id="content"><h1>Head &amp; tail</h1><p>First   paragraph,\n with <b>bold</b>, commas, and enough words to count.<p>Second one &lt;unclosed&gt;, also with commas, and words.
<ul><li>item one<li>item two</ul><script>var t="</p>";</script><form><p>Your name, please, and your address.</p></form></div>
<div class="comments"><p>Nice article, really, thank you very much, author.</p></div><aside>Other, things, to, read.</aside><div class="ad">Buy, now, cheap, and good.</div><footer>&copy; footer</footer>"""


def test_pages(spark):
    want = "Head & tail\nFirst paragraph, with bold, commas, and enough words to count.\nSecond one <unclosed>, also with commas, and words.\nitem one\nitem two"
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 5), (3, "v", "", 5), (None, "w", "<p>x", 5), (1, "u", PAGE, 5)], "page_id long, url string, html string, text int")
    got = html_extract.extract_pages(pages).collect()
    assert sorted((str(r["page_id"]), r["text"]) for r in got) == sorted([("1", want), ("1", want), ("2", ""), ("3", ""), ("None", "x")])
    assert html_extract.extract_pages(pages.limit(0)).collect() == []
    assert html_extract.extract("<div>" * 5000 + "deep" + "<p" * 2000) == "deep"
    assert html_extract.extract("<nav><p>only, furniture, here, and no text at all</p></nav>") == ""


def test_chat_round_trips(spark):
    rng = random.Random(7)
    bits = ["</turn>", "### ", ": ", "\\", "\n", "<", "assistant", "#chat raw\n", "/turn>", "x", "é😀", "</tu", "\\###"]
    rows = [(c, k, rng.choice(["user", "assistant", None, "a: b", "r:", "</turn>"]), rng.choice([None, ""] + ["".join(rng.choice(bits) for _ in range(rng.randrange(8))) for _ in range(20)])) for c in range(60) for k in range(rng.randrange(1, 6))]
    rows += [(None, 0, "user", "null conversation"), (1, 0, "user", "tie"), (1, None, "user", "null turn"), (70, 0, "user", "y" * 50000)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, source string")
    got = {r["conv_id"]: r for r in chat.format_conversations(table).withColumn("mask", chat.loss_mask()).withColumn("learned", chat.learned_text()).collect()}
    for c in {r[0] for r in rows}:
        want = sorted(((k is not None, k or 0, r or "", t or "") for cc, k, r, t in rows if cc == c))
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, t) for _, _, r, t in want]
        at, learned, f = 0, "", got[c]["formatted"].encode()
        for run in got[c]["mask"]:
            at += run["marks"]
            if run["learned"]:
                part = f[at : at + run["text"]].decode()
                learned += re.sub(r"(?s)\\(.)", r"\1", part) if f.startswith(chat.ESCAPED.encode()) else part
            at += run["text"]
        assert at + len(chat.CLOSE) + 1 == len(f)
        assert learned == got[c]["learned"] == "".join(t for _, _, r, t in want if r == "assistant")
    assert chat.format_conversations(table.limit(0)).collect() == []


def test_one_of_each_group_stays(spark):
    near = " ".join(f"word{i}" for i in range(400))
    docs = spark.createDataFrame([(3, near + " a"), (5, near + " b"), (5, "quite another text of the same id"), (7, near + " b"), (None, near + " b"), (9, "alone")], "doc_id long, text string")
    found = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert found == {(3, 3), (5, 3), (5, 5), (7, 3), (None, 3), (9, 9)}
    kept = sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect())
    assert kept == [(3, near + " a"), (5, "quite another text of the same id"), (9, "alone")]
