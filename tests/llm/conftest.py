import pytest

SF = "/root/testdata/sf0.001"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau".split()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest documents as Python rows."""
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


EDGES = [
    (9001, None),
    (9002, ""),
    (9003, "   \n\t "),
    (9004, "one"),
    (9005, "ONE two"),
    (9006, "é ü 漢字 мир 🙂 x" * 3),
    (9007, " ".join(WORDS * 400)),
    (9008, " ".join(WORDS * 400)),
    (9008, " ".join(WORDS * 400)),
    (9009, "<|endoftext|> a  b   c\n\n d\t<|endoftext|>e "),
    (None, "a row without an id"),
]


@pytest.fixture
def make(spark):
    """Documents with every kind of odd row and columns whose names clash."""

    def build(rows):
        schema = (
            "doc_id long, text string, lang string, source string, n_chars long, bits long, u long, n long, "
            "start int, kept boolean, score double, _bucket int, component_id long, shard int, piece int"
        )
        full = [(i, t, None, None, None if t is None else len(t), 1, 2, 3, 4, True, 0.5, 6, 7, 8, 9) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture
def edges():
    return list(EDGES)
