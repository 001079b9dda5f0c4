"""New cuts of a text are kept by the short way, with the library's ids."""

import public_tokenizers

from unravel.llm import tokens


def test_short_way(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, text = tokens.Encoder(path, kept=20), "the Zyxwvut zyxwvut. Zyxwvut, (odd) it's naïve ÀÉ a_b x9 end?! " * 3 + "end"
    slow = []
    monkeypatch.setattr(own, "cut_ids", lambda before, cut: slow.append(cut) or tokens.Encoder.cut_ids(own, before, cut))
    for part in (text, text.upper(), text):
        assert own.encode(part) == own.uncut(part)
    assert "zyxwvut." not in slow and "a_b" in slow
