"""Plain restatements of the metrics on Python lists, to check the columnar ones against."""

import math
import re
from collections import Counter


def grams(tokens, n):
    return Counter(tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1))


def tokens_13a(text):
    text = text.rstrip().replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for old, new in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(old, new)
    text = f" {text} "
    for pattern, new in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
                         (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        text = re.sub(pattern, new, text)
    return text.split()


def bleu(pairs, tokenize=tokens_13a):
    match, total, hyp_len, ref_len = [0] * 4, [0] * 4, 0, 0
    for hyp, ref in pairs:
        h, r = tokenize(hyp), tokenize(ref)
        hyp_len, ref_len = hyp_len + len(h), ref_len + len(r)
        for n in range(4):
            match[n] += sum((grams(h, n + 1) & grams(r, n + 1)).values())
            total[n] += max(len(h) - n, 0)
    if not any(match) or not all(total):
        return 0.0
    logs, halvings = [], 1
    for m, t in zip(match, total):
        if m == 0:
            halvings *= 2
        logs.append(math.log(100 / (halvings * t) if m == 0 else 100 * m / t))
    brevity = 1.0 if hyp_len >= ref_len else math.exp(1 - ref_len / hyp_len)
    return brevity * math.exp(sum(logs) / 4)


def chrf_words(text):
    marks, out = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), []
    for w in text.split():
        if len(w) > 1 and w[-1] in marks:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in marks:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def chrf(pairs, word_order=0):
    sums = Counter()
    for hyp, ref in pairs:
        for kind, orders, h, r in (("c", 6, "".join(hyp.split()), "".join(ref.split())),
                                   ("w", word_order, chrf_words(hyp), chrf_words(ref))):
            for n in range(1, orders + 1):
                gh, gr = grams(h, n), grams(r, n)
                sums[kind, n, "m"] += sum((gh & gr).values())
                sums[kind, n, "h"] += sum(gh.values()) if gr else 0
                sums[kind, n, "r"] += sum(gr.values())
    used = [(sums[k, n, "m"], sums[k, n, "h"], sums[k, n, "r"]) for k, top in (("c", 6), ("w", word_order))
            for n in range(1, top + 1)]
    used = [(m, h, r) for m, h, r in used if h and r]
    if not used:
        return 0.0
    p, r = (sum(u[0] / u[i] for u in used) / len(used) for i in (1, 2))
    return 500 * p * r / (4 * p + r) if p + r else 0.0


def meteor_sentence(hyp, ref, stages=(str,)):
    """One sentence; every stage maps tokens to the form it compares."""
    left_h, left_r, matches = list(enumerate(hyp)), list(enumerate(ref)), []
    for form in stages:
        for h in reversed(list(left_h)):
            for r in reversed(left_r):
                if form(h[1]) == form(r[1]):
                    matches.append((h[0], r[0]))
                    left_h.remove(h)
                    left_r.remove(r)
                    break
    if not matches:
        return 0.0
    matches.sort()
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(matches, matches[1:]))
    p, r = len(matches) / len(hyp), len(matches) / len(ref)
    return (1 - 0.5 * (chunks / len(matches)) ** 3) * p * r / (0.9 * p + 0.1 * r)


def meteor(pairs, stages=(str,)):
    scored = [meteor_sentence([t.lower() for t in tokens_13a(h)], [t.lower() for t in tokens_13a(r)], stages)
              for h, r in pairs]
    return sum(scored) / len(scored)
