"""Ids put together from pieces, against ids of whole texts."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from ashlar.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_those_of_whole_texts():
    """Letters that turn into a letter and a mark joined the full stop behind them; pieces gave other ids."""
    texts = ["aİ.", "aİ%%", "क़.", "it's don't 'tis a's.", "x<|endoftext|>y", "ÉÉ. Ǆ, ŉ.", "a__ _a_ a-b a..b", "1a 2. ²", "ẞ.", "x\x85y", "", " "]
    draw = random.Random(3)
    texts += ["".join(draw.choice("abAB .,%'’<|>İßक़é́̇Ǆ1² \n\t_-日ʼn") for _ in range(draw.randint(1, 30))) for _ in range(5000)]
    encode, whole = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    assert encode.by_pieces
    assert [t for t in texts if encode(t.encode()).tolist() != whole.encode(t, add_special_tokens=False).ids] == []


def test_words_are_encoded_side_by_side():
    """Each new word was a call's item of its own."""
    encode, asked = packing.Encoder(PATH), []

    class Spy:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    whole, encode.tokenizer = encode.tokenizer, Spy()
    encode(b"one two%% three, four five! x1")
    assert len(asked) == 5 and sorted(asked[0].split()) == ["five", "four", "one", "three", "two"]


def test_letters_go_to_the_model_without_normaliser():
    """New words a-z, capitals lowered, ask the model alone where there are enough of them; ids are those of the whole text."""
    words = [a + b for a in ("plain", "zqx", "Unheard", "ING") for b in ("", "a", "jk", "tion", "ed")]
    text = " ".join(words) + ". " + ", ".join(words).upper() + "!"
    encode = packing.Encoder(PATH)
    wanted = encode.tokenizer.encode(text, add_special_tokens=False).ids
    encode(b". , !")  # marks are known from here on
    encode.tokenizer = None
    assert encode(text.encode()).tolist() == wanted
