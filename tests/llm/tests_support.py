"""Plain versions of what the operators compute."""
import re


def brute_components(texts, percent):
    """Sizes of shingle sets, and the least index reachable by links, from all pairs."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in (t or "")))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return [len(s) for s in sets], root


def plain_encoding(text, name):
    from tokenizers import Tokenizer

    from relinker.llm import bpe

    t = Tokenizer.from_file(bpe.tokenizer_path(name))
    t.no_truncation()
    t.no_padding()
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)
