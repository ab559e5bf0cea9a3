import pytest

from ampliq.__main__ import options, parse
from ampliq.plans.options import AmpliconError, Options


@pytest.mark.parametrize(
    "bad",
    [dict(d=256), dict(threads=0), dict(fastidious=True, d=2), dict(boundary=3), dict(fastidious=True, boundary=1), dict(match=2), dict(d=2, match=0), dict(d=2, gap_open=0, gap_extend=0), dict(network=True, d=2), dict(disable_sse3=True), dict(fastidious=True, ceiling=39), dict(fastidious=True, bloom_bits=65), dict(default_abundance=0)],
)
def test_refused(bad):
    with pytest.raises(AmpliconError):
        Options(**bad).checked()


def test_costs():
    assert Options().penalties == (18, 24, 13)
    assert Options(d=2, match=2, mismatch=4, gap_open=6, gap_extend=3).penalties == (3, 3, 2)


def test_letters():
    given, files = parse(["-d", "2", "-n", "x.fas"])
    assert files == ["x.fas"] and options(given) == Options(d=2, breaking=False)
    for args in (["-d", "1", "-d", "2"], ["-q"]):
        with pytest.raises(AmpliconError):
            parse(args)
    with pytest.raises(AmpliconError):
        options({"d": "x"})
