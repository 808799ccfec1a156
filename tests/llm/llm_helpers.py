import re


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words8(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
