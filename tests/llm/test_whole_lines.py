"""Lines and tokens that the given tables do not hold."""

from cloakwork.llm.quality_rules import clean_lines
from cloakwork.llm.tokens import Encoder


def test_long_lines(spark):
    clean = " ".join(f"word{i}" for i in range(100))
    texts = ["spam " * 100_000, clean + " de de de de " + clean, "de de de de " + "a b c d e f g"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {x.doc_id: x.clean_text for x in clean_lines(df, by_share=True).collect()}
    assert by == {0: "", 1: texts[1], 2: ""}
    by = {x.doc_id: x.clean_text for x in clean_lines(df).collect()}
    assert by == {0: "", 1: "", 2: ""}


def test_special_tokens_as_the_library_does_by_default():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), Encoder(path, special=True)
    for text in ("hello <|endoftext|> you", "hello<|endoftext|>you <|startoftext|>", "<|startoftext|>a,<|endoftext|>.", "<|ENDOFTEXT|> x"):
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
