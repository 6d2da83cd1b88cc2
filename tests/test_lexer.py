from __future__ import annotations

import pytest

from tallyscope.functions.lexer import BLOCK, CODE, STRING, LineFacts, count_alias, file_facts, is_code, line_facts, split_lines, string_marks, untangle
from tallyscope.languages import built_in

LANGUAGES = built_in()
PYTHON, JAVA, PHP, HASKELL = (LANGUAGES[x] for x in ("Python", "Java", "PHP", "Haskell"))
DOUBLE, SINGLE = STRING, STRING + 1  # both Python's and, for the first, Java's

PYTHON_LINES = [
    ("Hello# world!", CODE, "Hello", False, CODE),
    ("Hello# world!", SINGLE, None, True, SINGLE),
    ('"Hello" world!', CODE, " world!", True, CODE),
    ('"Hello" world!', DOUBLE, "Hello", True, DOUBLE),
    ("'Hello#' world!'", CODE, " world!", True, SINGLE),
    ("'Hello#' world!'", SINGLE, "Hello", True, CODE),
    ("''#Hello", CODE, None, True, CODE),
    ("#Hello", CODE, None, False, CODE),
    ("'\\'\\'\\''", CODE, None, True, CODE),
    ('"""Hello"', CODE, None, True, CODE),
    ('"""Hello"', DOUBLE, "Hello", True, DOUBLE),
    ("'\"He'llo'\" world!'", CODE, "llo", True, CODE),
    ("x = \"it's\"", CODE, "x = ", True, CODE),
    ("['a', 'b", CODE, "[, ", True, SINGLE),
    ('say \\" \'', DOUBLE, "", True, CODE),  # the open symbol is only there escaped: the other one closes
]
JAVA_LINES = [
    ("*/Hello world!", BLOCK, "Hello world!", False, CODE),
    ("*/Hello world!", CODE, "*/Hello world!", False, CODE),
    ("Hello*//**//**/ world!", BLOCK, " world!", False, CODE),
    ("Hello*//**//**/ world!", CODE, "Hello*/ world!", False, CODE),
    ("/*H*/ello world/*!", CODE, "ello world", False, BLOCK),
    ("/*H*/ello world/*!", BLOCK, "ello world", False, BLOCK),
    ('"', CODE, None, True, DOUBLE),
    ("He//llo//", CODE, "He", False, CODE),
    ("////Hello", CODE, None, False, CODE),
    ('"He"/*l*/lo//fd', CODE, "lo", True, CODE),
    ('"He"/*l*/lo//fd', BLOCK, "lo", False, CODE),
    ('"He"/*l*/lo//fd', DOUBLE, "He", True, DOUBLE),
    ('""He"""ll"o', CODE, "Heo", True, CODE),
    ('""one"//"""Hello world!', CODE, "oneHello world!", True, CODE),
    ('//"/**/dfd"', CODE, None, False, CODE),
    ('//"/**/dfd"', BLOCK, "dfd", True, DOUBLE),
    ('Hello /* mefm " */ " //*/world!', CODE, "Hello  ", True, DOUBLE),
    ('Hello /* mefm " */ " //*/world!', DOUBLE, " */ ", True, DOUBLE),
    ("Hello world*//**/", BLOCK, None, False, CODE),
    ("text", BLOCK, None, False, BLOCK),
    ("text", DOUBLE, None, True, DOUBLE),
    ("/* a */ // b", CODE, " ", False, CODE),
    ('"x" }', CODE, " }", True, CODE),
    ("*//*x", BLOCK, "", False, BLOCK),
    ('"a"/* x', CODE, None, False, BLOCK),
    ('"a"/* x */', CODE, None, True, CODE),
    ("/* /* */ */", CODE, " */", False, CODE),
    ('/* x */"foo"', CODE, "foo", True, DOUBLE),
    ('/* x */ "foo"', CODE, " ", True, CODE),
    ('/* x */"', CODE, None, True, CODE),
    ("*/ */ /* x */ y", CODE, "*/ */  /* x */ y"[:6], False, BLOCK),
    ("/* a *///c", CODE, "//c", False, CODE),
]


@pytest.mark.parametrize("text,state,cleansed,literal,after", PYTHON_LINES)
def test_lines_without_blocks(text, state, cleansed, literal, after):
    assert line_facts(text, PYTHON, state) == LineFacts(cleansed or None if cleansed == "" else cleansed, literal, after)


@pytest.mark.parametrize("text,state,cleansed,literal,after", [x for x in JAVA_LINES if not x[0].startswith("*/ */")])
def test_lines_with_blocks(text, state, cleansed, literal, after):
    assert line_facts(text, JAVA, state) == LineFacts(cleansed, literal, after)


def test_one_stray_end_is_passed_over():
    found = line_facts("*/ */ /* x */ y", JAVA)
    assert found.state == CODE and found.cleansed == "*/ */  /* x */ y"


def test_other_languages():
    assert line_facts("# class // x", PHP) == LineFacts("# class ", False, CODE)
    assert line_facts("{-- foo", HASKELL) == LineFacts("{", False, CODE)
    assert line_facts("<p><!-- a --> b", LANGUAGES["HTML"]) == LineFacts("<p> b", False, CODE)


@pytest.mark.parametrize(
    "text,symbols,open_symbol,want",
    [
        ('"\'"Hello', 2, None, [(0, 0), (2, 0)]),
        ('"\'"Hello', 2, 1, [(1, 1), (2, 0)]),
        ('"\'"Hello', 2, 0, [(0, 0), (1, 1)]),
        ("'\"'\"''\"He'l\"lo", 2, None, [(0, 1), (2, 1), (3, 0), (6, 0), (9, 1)]),
        ("\\'\\\\'\\\\'\\\\\\''", 2, None, [(4, 1), (7, 1), (12, 1)]),
        ('"\\"\\\\""', 1, None, [(0, 0), (5, 0), (6, 0)]),
        ('no "', 2, 1, []),
    ],
)
def test_string_marks(text, symbols, open_symbol, want):
    assert string_marks(text, ('"', "'")[:symbols], open_symbol) == want


@pytest.mark.parametrize(
    "starts,ends,in_block,want",
    [
        ([0, 9, 19], [7, 17], False, ([0, 9, 19], [7, 17])),
        ([0, 4], [3], False, ([0], [3])),
        ([1, 4], [0, 5], False, ([1], [5])),
        ([1, 4], [0, 5], True, ([4], [0])),
        ([0, 2, 7, 11], [1, 3, 6, 8, 14], False, ([0, 7, 11], [3, 14])),
        ([0, 2, 7, 11], [1, 3, 6, 8, 14], True, ([7, 11], [1, 3, 14])),
        ([0, 4, 6, 9], [3, 5, 7], False, ([0, 6, 9], [3])),
    ],
)
def test_untangle(starts, ends, in_block, want):
    untangle(starts, ends, in_block, 2)
    assert (starts, ends) == want


@pytest.mark.parametrize(
    "text,classes,interfaces",
    [
        ("Hello world!", 0, 0), ("class", 1, 0), ("1class", 0, 0), ("class class class", 3, 0), ("classclass", 0, 0), ("hello,class{word!", 1, 0), ("classe,", 0, 0),
        ("class interfaceclass classinterface interface", 1, 1), ("{class,interface}", 1, 1), ("{class.interface}", 0, 0), ("classclass classclass", 2, 0), ("(class)", 0, 0),
    ],
)
def test_keywords(text, classes, interfaces):
    assert (count_alias(text, "class"), count_alias(text, "interface")) == (classes, interfaces)


def test_split_lines():
    assert split_lines("") == [] and split_lines("a") == ["a"] and split_lines("a\n") == ["a"] and split_lines("a\r\n\r\nb") == ["a", "", "b"]
    assert split_lines("\n") == [""] and split_lines("a\r") == ["a\r"]


def test_braces():
    for text in ("{", "}", "};"):
        assert not is_code(line_facts(text, JAVA)) and is_code(line_facts(text, JAVA), True)
    assert is_code(line_facts("} else {", JAVA)) and not is_code(line_facts('"x" }', JAVA))


def test_whole_file():
    text = 'package a;\n\n/* a class\n   in a comment\n*/\npublic class A {  // class\n    String s = "class";\n    record B\n}\n  \n"open\nclass inside\nend" ;\ninterface C {\n};\n'
    assert file_facts(text, JAVA) == (15, 8, [2, 1])
    assert file_facts(text, JAVA, braces_as_code=True) == (15, 10, [2, 1])
    assert file_facts(text, JAVA, keywords=False) == (15, 8, [0, 0])
    assert file_facts("", JAVA) == (0, 0, [0, 0])
