"""Character classes shared by the text functions.

``STRIP_CHARS`` is the set a Unicode-aware ``strip`` removes (the White_Space
property plus the four information separators).  It is spelled out instead of
using ``(?U)\\s`` so the same set drives ``btrim`` (linear, no regex) and the
regex classes below.
"""

# Fixed values.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Inside a Java character class: every strip character except the line feed.
INLINE_SPACE = r"\t\x0b\x0c\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ANY_SPACE = r"\n" + INLINE_SPACE

# A "word" character: letter, number or underscore.  Boundaries are written as
# look-arounds because the meaning of \b changed between Java releases.
WORD = r"\p{L}\p{N}_"
NOT_AFTER_WORD = rf"(?<![{WORD}])"
NOT_BEFORE_WORD = rf"(?![{WORD}])"
