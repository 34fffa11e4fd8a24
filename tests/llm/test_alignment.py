"""Alignment of two tokenizers against a plain reading token by token, over all documents of the smallest tables and odd texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from steplens.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["x ", " ", "  ", "a  b", "a\n b", "a\n\n  b ", "é è  z", "　 a", "▁ a", "<|endoftext|> <s> </s>", "日本 語" * 300, "don't 've", "😀 😀", "a\u0085 b", "\x1c a", "\x00", "\t\t x", "", None, "same text", "same text", "<0x0A>", "x" * 5000, "a  b  c"]


def spans(pieces):
    out, at = [], 0
    for i, b in pieces:
        out.append((i, at, at + len(b)))
        at += len(b)
    return out


def plain(rows):
    """Rows of the contract from the two libraries themselves, with a look at every pair of overlapping tokens."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    own = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    made, held = [], Counter()
    for doc_id, text in rows:
        given = (" " + (text or "")).encode()
        a = [(i, bytes(letters[c] for c in one.id_to_token(i))) for i in one.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()) for i in two.encode(text or "") for p in [two.id_to_piece(i)]]
        if not text or b"".join(x for _, x in a) != given or b"".join(x for _, x in b) != given:
            made.append((doc_id, 0, 0, 0, [], ""))
            continue
        a, b = spans(a), spans(b)
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        links, j = [], 0
        for x, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((x, b[k][0]))
                k += 1
        groups, i, j = [], 0, 0
        for end in ends:
            left, right = [], []
            while i < len(a) and a[i][2] <= end:
                left.append(str(a[i][0]))
                i += 1
            while j < len(b) and b[j][2] <= end:
                right.append(str(b[j][0]))
                j += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        made.append((doc_id, len(a), len(b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        held.update(set(links))
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [(d, n, m, g, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), sha) for d, n, m, g, links, sha in made]


def rows_of(found):
    return sorted(str((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])) for r in found.collect())


def test_every_document(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = queries.op12_token_alignment(spark, sf_dir)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(got) == sorted(map(str, plain([tuple(r) for r in docs.collect()])))


@pytest.mark.parametrize("part", [1, 200, alignment.PART_BYTES])
def test_odd_texts_in_parts_of_any_size(spark, monkeypatch, part):
    rng = random.Random(part)
    words = [" ", "\n", "the", "Ünder", "語", "1234", "'s", "…", " ", "\t", "▁"]
    rows = [(i, t) for i, t in enumerate(ODD)] + [(i, "".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(100, 180)] + [(3, "a  b"), (None, "null id")]
    extra = ("f", 1, "p", [1], "g")
    docs = spark.createDataFrame([(*r, *extra) for r in rows], "doc_id long, text string, groups string, part int, pairs string, places array<int>, docs string").coalesce(2)
    monkeypatch.setattr(alignment, "PART_BYTES", part)
    monkeypatch.setattr(alignment, "STEP_BYTES", min(part, 400))
    assert rows_of(alignment.align_documents(docs, A, B)) == sorted(map(str, plain(rows)))


def test_groups_and_pair_counts(spark):
    docs = spark.createDataFrame([(1, "unbelievable"), (2, "unbelievable"), (3, None)], "doc_id long, text string")
    texts = {r["doc_id"]: (r["groups"], r["groups_sha256"]) for r in alignment.align_documents(docs, A, B, with_groups=True).collect()}
    assert texts[1] == texts[2] and hashlib.sha256(texts[1][0].encode()).hexdigest() == texts[1][1] and texts[3] == ("", "")
    counts = alignment.pair_counts(alignment.coded(docs, A, B)).collect()
    assert counts and {r["docs"] for r in counts} == {2} and all(r["best"] and r["pair"] == (r["a"] << 32) | r["b"] for r in counts)


def test_empty_table(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
