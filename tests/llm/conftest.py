import pytest


@pytest.fixture(scope="session")
def texts():
    """Awkward texts: null, empty, blank, ties, non-ASCII, one very long."""
    return [None, "", "  \n\t", "A", "a b", "The Cat sat.", "the cat sat.", "x y İstanbul 한글 ok", "tab\tand  two spaces\n",
            "word " * 30000, "The Cat sat.", "é" * 50]
