"""What the tests of the llm operators share: the smallest tables and plain words."""

import re

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")
