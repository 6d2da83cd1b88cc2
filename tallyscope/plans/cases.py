"""Lines whose facts are known, for the queries that hold the lexer against them."""

from __future__ import annotations

# Language, state before, line, text outside strings and comments, whether it has a literal, state after; @ is a part's name.
STRINGS = [
    ("Python", 0, "@# world!", "@", False, 0), ("Python", 3, "@# world!", None, True, 3), ("Python", 0, '"@" world!', " world!", True, 0), ("Python", 2, '"Hello" @!', "Hello", True, 2),
    ("Python", 0, "'@#' world!'", " world!", True, 3), ("Python", 3, "'Hello#' @!'", "Hello", True, 0), ("Python", 0, "''#@", None, True, 0), ("Python", 0, "#@", None, False, 0), ("Python", 0, r"'\'@\'\''", None, True, 0),
    ("Python", 0, '"""@"', None, True, 0), ("Python", 2, '"""@"', "@", True, 2), ("Python", 0, "x = \"@'s\"", "x = ", True, 0), ("Python", 0, "['@', 'b", "[, ", True, 3), ("Python", 2, "@ \\\" '", None, True, 0),
    ("Python", 0, r'\"@', r'\"@', False, 0), ("Python", 0, r'\\"@', r"\\", True, 2), ("Python", 0, "@ 'a' \"b\" # 'c", "@   ", True, 0), ("Java", 0, '"', None, True, 2), ("Java", 2, "@", None, True, 2), ("Java", 0, '""@""" "o', "@o", True, 0),
]
BLOCKS = [
    ("Java", 1, "*/@!", "@!", False, 0), ("Java", 0, "*/@!", "*/@!", False, 0), ("Java", 1, "@*//**//**/ world!", " world!", False, 0), ("Java", 0, "@*//**//**/ world!", "@*/ world!", False, 0),
    ("Java", 0, "/*@*/ello world/*!", "ello world", False, 1), ("Java", 0, "@//llo//", "@", False, 0), ("Java", 0, "////@", None, False, 0), ("Java", 0, '"@"/*l*/lo//fd', "lo", True, 0), ("Java", 1, '"@"/*l*/lo//fd', "lo", False, 0),
    ("Java", 2, '"He"/*@*/lo//fd', "He", True, 2), ("Java", 0, '//"/**/@"', None, False, 0), ("Java", 1, '//"/**/@"', "@", True, 2), ("Java", 1, "@*//**/", None, False, 0), ("Java", 1, "@", None, False, 1), ("Java", 0, "@/*/x", "@", False, 1), ("Java", 0, "@/*/*/x", "@x", False, 0),
]
QUIRKS = [
    ("Java", 0, "/* @ */ // b", " ", False, 0), ("Java", 0, '"@" }', " }", True, 0), ("Java", 1, "*//*@", "", False, 1), ("PHP", 0, "# class // @", "# class ", False, 0), ("Haskell", 0, "{-- @", "{", False, 0), ("Java", 0, '"@"/* x', None, False, 1),
    ("Java", 0, '"@"/* x */', None, True, 0), ("Java", 0, "/* @ /* */ */", " */", False, 0), ("Java", 0, '/* x */"@"', "@", True, 2), ("Java", 0, '/* @ */ "foo"', " ", True, 0), ("Java", 0, '/* @ */"', None, True, 0),
    ("Java", 0, "*/ */ /* @ */ y", "*/ */  /* @ */ y", False, 0), ("Java", 0, "/* a *///@", "//@", False, 0), ("Java", 0, "// @ don't", None, False, 0), ("HTML", 0, "<p><!-- @ --> b", "<p> b", False, 0), ("HTML", 0, "&none/ @", None, False, 0),
]
