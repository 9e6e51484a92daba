"""Statistics of the language model do not depend on how they are added up."""
from quern.llm import exchange, lm


def test_levels_of_sums_give_the_same_model(odd, monkeypatch):
    scores = lambda: sorted((str(r.doc_id), r.n_tokens, round(r.score, 3)) for r in lm.language_scores(odd, rounds=4).collect())
    whole = scores()
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 8192)
    monkeypatch.setattr(lm, "FAN", 2)
    assert exchange.sizes(exchange.text_bytes(odd, "text"), 2)[0] > 4
    assert scores() == whole
