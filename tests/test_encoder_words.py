import public_tokenizers
from tokenizers import Tokenizer

from brindle.functions.encoder import Encoder

TEXTS = ["one two two", " three  x", "don't stop, café Ünï 12ab a_b", "", "five\nsix <|x|> ²x x² ªb", "w" * 70 + " y" * 3, "ևա ςΣ end."]


def test_words_of_letters_do_not_meet_the_pattern():
    """op10: the pattern is for chunks that may hold several pieces only."""
    enc = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    seen, own = [], enc.pattern

    class Watched:
        def findall(self, text):
            seen.append(text)
            return own.findall(text)

    enc.pattern = Watched()
    enc.ids(["one two two", "two café, one1"])
    assert sorted("".join(seen).split("\n")) == ["", " café,", " one1"]


def test_ids_are_the_library_s_with_a_cache_that_turns_over():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        lib = Tokenizer.from_file(path)
        for size in (100, 3000, 1 << 20):
            enc = Encoder(path, size)
            for _ in range(3):
                for at in range(0, len(TEXTS), 2):
                    part = TEXTS[at : at + 2]
                    assert [list(memoryview(x).cast("I")) for x in enc.ids(part)] == [lib.encode(t, add_special_tokens=False).ids for t in part]
