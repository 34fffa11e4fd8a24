"""Segmentation by scores made of merge ranks, against a plain search, and settings of model files."""

from math import log

import public_tokenizers
import pytest
import sentencepiece

from steplens.llm import sentencepiece_codec as S

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_whole_texts_against_a_plain_search(spark, sf_dir):
    model, codec = sentencepiece.SentencePieceProcessor(model_file=PATH), S.Codec(PATH)
    score = {model.id_to_piece(i): -log(S.RANK_OFFSET - model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    longest = max(map(len, score))
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r["text"] and len(r["text"]) < 3000][:60]
    for text in [*texts, "a  b", " x", "é😀漢\n\n\tz"]:
        t = S.SPACE + text.replace(" ", S.SPACE)
        best = [0.0] + [float("-inf")] * len(t)
        for end in range(1, len(t) + 1):
            best[end] = best[end - 1] + codec.unknown_score
            for size in range(1, min(longest, end) + 1):
                if (s := score.get(t[end - size : end])) is not None:
                    best[end] = max(best[end], best[end - size] + s)
        ids = codec.encode([text])[0].tolist()
        assert codec.decode(ids) == text
        got, open_bytes = 0.0, b""
        for i in ids:
            if model.is_byte(i):
                open_bytes += codec.bytes_of[i]
                try:
                    open_bytes.decode()
                except UnicodeDecodeError:
                    continue
                got, open_bytes = got + codec.unknown_score, b""
            else:
                got += score[model.id_to_piece(i)]
        assert got == pytest.approx(best[-1])


def test_no_more_ids_than_merging_gives(spark, sf_dir):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    merged = sum(map(len, sentencepiece.SentencePieceProcessor(model_file=PATH).encode(texts)))
    assert 0.98 * merged < len(S.codec(PATH).encode(texts)[0]) < merged


def test_files_of_other_text_rules_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    for name, value in (("add_dummy_prefix", False), ("remove_extra_whitespaces", True), ("escape_whitespaces", False), ("precompiled_charsmap", b"x")):
        model = sentencepiece_model_pb2.ModelProto()
        with open(PATH, "rb") as f:
            model.ParseFromString(f.read())
        setattr(model.normalizer_spec, name, value)
        path = tmp_path / f"{name}.model"
        path.write_bytes(model.SerializeToString())
        with pytest.raises(ValueError, match="text rules"):
            S.settings(str(path))
    assert S.settings(PATH) == S.BPE
