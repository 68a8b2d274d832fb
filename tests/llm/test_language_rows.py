"""The language model learns from every row of its training folds."""

import zlib

from storyloom.llm import language
from storyloom.llm.language import HELD, HELD_FOLDS, MIX_FOLD, Model
from storyloom.llm.language import vocabulary
from storyloom.tables import written


def test_rows_that_fit_weights_also_teach_contexts(spark):
    texts = []
    for i in range(70):
        part = zlib.crc32(str(i).encode()) % HELD_FOLDS
        if part != HELD:
            texts.append(("only here stands this" if part == MIX_FOLD else "plain words go elsewhere", part))
    docs = spark.createDataFrame(texts, "text string, part int")
    model = Model(spark, docs, written(vocabulary(docs), "vocabulary"))
    code = model.code
    for text in ("only here stands this", "plain words go elsewhere"):
        symbols, first, _ = language.flat_symbols(code, [language.words_of(text)])
        (_, found, _, _, _), = language.token_blocks(code, symbols, first)
        # A context without counts has no trust.
        assert all((model.words.trust[k, s] > 0).all() for k, s in enumerate(found))

