"""Direct single-process forms of the ordered operators, for comparison in tests."""

from __future__ import annotations

import math
import re
from collections import Counter

STAR = "<*>"


def pattern(tokens):
    text = re.sub(r"(?:<\*>\s?){2,}", STAR, " ".join(tokens))
    return re.compile("^" + "(.*?)".join(re.escape(p) for p in text.split(STAR)) + "$")


def merge(template, tokens):
    if not template:
        return list(tokens)
    both = set(template) & set(tokens)
    longer = tokens if len(tokens) > len(template) else template
    return [t if t in both else STAR for t in longer]


class Node:
    def __init__(self):
        self.kids, self.clusters = {}, []


class Miner:
    """Lines one by one: vocabulary, group, bounded tree, best cluster."""

    def __init__(self, k, depth, max_child, st, stop, vocab=True):
        self.k, self.depth, self.max_child, self.st, self.stop = k, depth, max_child, st, set(stop)
        self.counts, self.roots, self.vocab = Counter(), {}, vocab

    def words(self, tokens):
        return [t for t in tokens if len(t) > 2 and t.lower() not in self.stop]

    def group(self, tokens):
        self.counts.update(self.words(tokens))
        ranked = sorted(set(self.words(tokens)), key=lambda t: (-self.counts[t], t))
        return " ".join(sorted(ranked[: self.k]))

    def add(self, line_id, tokens, group=None):
        tokens = list(tokens)
        if group is None:
            group = self.group(tokens)
        node = self.roots.setdefault(group, Node())
        for i in range(min(self.depth, len(tokens))):
            t = tokens[i]
            if t not in node.kids:
                if STAR in node.kids or len(node.kids) >= self.max_child:
                    t = STAR
                node.kids.setdefault(t, Node())
            tokens[i] = t
            node = node.kids[t]
        text, best = " ".join(tokens), None
        for cluster in node.clusters:
            if pattern(cluster["tokens"]).match(text):
                sim = 1.0
            else:
                a, b = set(cluster["tokens"]), set(tokens)
                sim = len(a & b) / len(a | b)
            if best is None or sim >= best[0]:
                best = (sim, cluster)
        if best and best[0] >= self.st:
            cluster = best[1]
            cluster["tokens"] = merge(cluster["tokens"], tokens)
        else:
            cluster = {"id": line_id, "tokens": tokens}
            node.clusters.append(cluster)
        return group, tokens[: self.depth], cluster["id"], list(cluster["tokens"])


class Bayes:
    def __init__(self):
        self.docs, self.grams, self.order = Counter(), {}, []

    def fit(self, tokens, label):
        if label not in self.docs:
            self.order.append(label)
        self.docs[label] += 1
        for t in tokens:
            self.grams.setdefault(t, Counter())[label] += 1

    def predict(self, tokens):
        v, best = max(len(self.grams), 1), None
        ones = [c[1] for c in self.grams.values() if c[1]]
        mean = sum(ones) / len(ones) if ones else 0.0
        for label in self.order:
            p = math.log(self.docs[label] / sum(self.docs.values()))
            for t in tokens:
                c = self.grams.get(t, Counter())
                total = sum(c.values())
                if label == 1 and not c[1]:
                    p += math.log((mean + 1) / (total + v))
                else:
                    p += math.log((c[label] + 1e-5) / (total + 1e-5 * v))
            if best is None or p > best[0]:
                best = (p, label)
        return best and best[1]
