"""What a worker keeps of op7's encoder between tasks."""

import pyarrow as pa

from filarium.llm import bpe, packing as P


def ids(texts, path, **kept):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    return [x.tolist() for _, rows in bpe.token_stream([batch], P.library_encoder(path) if not kept else kept["encode"], cache=kept.get("cache")) for x in rows]


def test_worker_keeps_encoder_and_words(monkeypatch):
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    encode, met = P.worker_encoder(path)
    assert P.worker_encoder(path)[0] is encode
    calls = []

    def counted(words):
        calls.append(len(words))
        return encode(words)

    met.clear()
    texts = [["one two three", None, "two  four\n"], ["two one five", ""], ["six seven one", "two"]]
    for t in texts[:2]:
        assert ids(t, path, encode=counted, cache=met) == ids(t, path)
    assert calls[1] < calls[0]  # words met before are not encoded again
    monkeypatch.setattr(bpe, "_CACHE_WORDS", 3)  # full: forgotten, and all words are encoded anew
    assert ids(texts[2], path, encode=counted, cache=met) == ids(texts[2], path)
    assert len(met) <= 4
