"""The rule semantics stated in plain Python, for comparison."""


def redact(text, rules, style):
    total = 0
    for rule in rules:
        pieces, at = [], 0
        for m in rule.compiled().finditer(text):
            mark = "[REDACTED]" if style == "label" else "█" * max(1, m.end() - m.start())
            pieces += [text[at : m.start()], mark]
            at, total = m.end(), total + 1
        text = "".join(pieces) + text[at:]
    return text, total


def detect(text, rules):
    found = {}
    for rule in rules:
        n = sum(1 for _ in rule.compiled().finditer(text))
        if n:
            found[rule.label] = found.get(rule.label, 0) + n
    return found
