import pytest


@pytest.fixture(scope="session")
def tokenizer():
    """Where the vocabulary files of the public tokenizers lie, by name."""
    return pytest.importorskip("public_tokenizers").path
