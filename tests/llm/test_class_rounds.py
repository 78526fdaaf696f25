"""Which words are clustered in rounds."""

import pytest

from tessella.llm import class_lm


@pytest.mark.parametrize("n_words", [0, 1_000, 80_000_001, 10**9, 10**13])
def test_words_in_rounds_do_not_depend_on_the_size_of_the_text(n_words):
    assert class_lm.ClassParams().least(n_words) == 5
