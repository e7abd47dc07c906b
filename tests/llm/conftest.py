from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def path():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")
