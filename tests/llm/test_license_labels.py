"""Labels of licence notices, written by hand."""

from __future__ import annotations

import pytest

from platewise.llm import license_scan

GNU = """This program is free software{a} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software
Foundation{b} either version {v} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE.  See the {name} for more details.

You should have received a copy of the {name} along with this program{end}"""
FSF = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
WEB = ".  If not, see <https://www.gnu.org/licenses/>."


def gnu(name: str, v: str) -> str:
    old = v[0] == "2"
    return GNU.format(name=name, v=v, a=";" if old else ":", b=";" if old else ",", end=FSF if old else WEB)


def bsd(holder: str, clauses: int) -> str:
    head, names, tail = license_scan._BSD_HEAD, license_scan._BSD_NAMES, license_scan._BSD_TAIL
    return f"Copyright (c) 2024, {holder}. All rights reserved. {head} {names.replace('the copyright holder', holder) if clauses == 3 else ''} {tail}"


PERMISSION = license_scan.NOTICES[0].text
CASES = [
    (gnu("GNU General Public License", "3"), "gpl"),
    (gnu("GNU General Public License", "2"), "gpl"),
    (gnu("GNU Affero General Public License", "3"), "agpl"),
    (gnu("GNU Lesser General Public License", "3"), "lgpl"),
    (gnu("GNU Lesser General Public License", "2.1").replace("program", "library"), "lgpl"),
    (bsd("the copyright holder", 3), "bsd-3-clause"),
    (bsd("the Regents of the University of Some Northern State", 3), "bsd-3-clause"),
    (bsd("ACME", 3), "bsd-3-clause"),
    (bsd("Jane Doe", 2), "bsd-2-clause"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: be kind.", "bsd"),
    (PERMISSION, "mit"),
    ("MIT License. " + PERMISSION, "mit"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 3.0 Unported License.", "cc-by-nc-nd"),
    # The phrase "cc by" is a label of the base, which stays.
    ("Photo: CC BY-ND 4.0", "cc-by,cc-by-nd"),
    ("Photo: CC BY-NC-SA 3.0", "cc-by,cc-by-nc-sa"),
    ("Photo: CC BY 4.0", "cc-by"),
    # Two notices in one text, apart and side by side.
    (PERMISSION + " Elsewhere: " + gnu("GNU Affero General Public License", "3"), "agpl,mit"),
    (bsd("Jane Doe", 2) + " " + gnu("GNU General Public License", "2"), "bsd-2-clause,gpl"),
    ("This text speaks of the general public and of a license to print money.", ""),
    ("The lesser general public may redistribute what is free software, or not.", ""),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    return {r.doc_id: r for r in license_scan.license_spans(rows).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_labels(found, i):
    spans = found[i].spans
    assert ",".join(sorted({s.label for s in spans})) == CASES[i][1], spans


def test_templates_name_words_of_their_own(spark):
    with pytest.raises(ValueError):
        license_scan.template_positions(spark, (), (license_scan.Template("x", "one two three four five", "two four"),))
    rows = license_scan.template_positions(spark).collect()
    assert all(any(r.own for r in rows if r.template == t) for t in {r.template for r in rows})
