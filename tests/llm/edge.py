"""Rows that operators must not trip over."""

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(20_000))
PROSE = " ".join(f"plain{i} text{i * i % 89}" for i in range(60))

#: id, text: nulls, empty, white space alone, repeated rows, copies, a very long text.
EDGE_ROWS = [
    (None, None),
    (None, PROSE),
    (1, ""),
    (2, None),
    (3, " \n\t "),
    (4, PROSE),
    (4, PROSE),
    (5, PROSE),
    (6, LONG),
    (7, PROSE + "\n" + LONG),
    (8, "Ünïcödé 𝄞 ▁ text with\u0000odd ﻿characters"),
]
#: Columns that operators might want to call their own.
CLASHING = "d string, t string, w string, fp string, label string, _doc_id string, `a.b` string"
