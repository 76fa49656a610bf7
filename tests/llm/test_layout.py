"""The layout signals of text profiles: each of them decides rows."""

import pytest

from lodecast.llm import textstats

LIST = "- one lamp, old house, river\n- two\n- three chairs beside mill\n- four"
STRUNG = "seven red lamps; two old doors of Bonn; three chairs; the quiet harbour of Kiel; five ropes; six blue sails; nine masts"
TABLE = "a,b,c\nx,1,2\ny,3,4\nz,5,6"


@pytest.mark.parametrize(
    ("signal", "off", "text", "kind"),
    [("indent_periodicity", 0.0, LIST, "list"), ("delimiter_alignment", (0.0, ""), TABLE, "table"), ("length_autocorrelation", -1.0, STRUNG, "list")],
)
def test_each_signal_decides(monkeypatch, spark, signal, off, text, kind):
    assert textstats.profile(text)[-1] == kind
    monkeypatch.setattr(textstats, signal, lambda *_: off)
    assert textstats.profile(text)[-1] != kind


def test_columns_and_periods():
    assert textstats.delimiter_alignment(["a | b", "c | d", "e | f"], "|") == (1.0, "|")
    assert textstats.delimiter_alignment(["one, two words of a sentence that goes on", "no", "none"], ",")[0] == 0.0
    # Delimiters in the same columns count where a cell more stands in one of the lines.
    assert textstats.delimiter_alignment(["a | b | c", "d | e | f", "g | h"], "|")[0] == pytest.approx((1 + 1 + 0.5) / 3)
    assert textstats.indent_periodicity(["- a", "- b", "- c"]) == 1.0 and textstats.indent_periodicity(["a", "b", "c"]) == 0.0
    assert textstats.indent_periodicity(["x", "  - a", "    b", "  - c", "    d"]) == 0.75
    # What all lines are indented by says nothing.
    assert textstats.indent_periodicity(["    a", "    b", "    c"]) == 0.0
