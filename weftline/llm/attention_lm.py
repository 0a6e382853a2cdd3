"""A small causal self-attention language model in numpy, over words of subword ids.

A word is a run of ids of which only the first is one that begins a word. It is
drawn from a mixture of K components,

    p(word | context) = sum_k g_k(context) S_k(word),   S_k(word) = prod of P[id, k] over its ids,

which sums to 1 over all words, as ids that begin a word also end the one
before. The gate g is a softmax over the output of causal self-attention over
the words of the context window. A word's embedding is the mean over its ids of
their log odds by component, so words that were never seen have one too.

Windows of WIDTH words overlap: each word is scored once, and all windows of a
batch are one masked product.

`fit` starts P and the attention on a bounded sample; over all text, `learn`
adds the statistics from which `table` makes P, and trains the attention further.
"""

from __future__ import annotations

import numpy as np

K = 8
DIM = 4
WIDTH = 32
#: A window scores its last STEP words, the first one all of them: the least context is WIDTH - STEP words and the start.
STEP = 24
HEAD = WIDTH - STEP
#: Weight of the corpus-wide distribution in each component, and of a uniform one in that.
SMOOTH = 20.0
FLOOR = 0.1
#: Rate of the attention's steps.
RATE = 0.05
#: Largest log odds of an embedding.
ODDS = 4.0
_F = np.float32


def table(of: np.ndarray) -> np.ndarray:
    """log P (vocabulary x K) from expected counts of ids by component."""
    base = (of.sum(1) + FLOOR) / (of.sum() + FLOOR * len(of))
    return np.log((of + SMOOTH * K * base[:, None]) / (of.sum(0) + SMOOTH * K)).astype(_F)


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scored) of the windows of a text of n words: places index the text with its start before it, so place 0 is the start.

    Window w predicts words w*STEP .. w*STEP+WIDTH-1; all are scored in the
    first window, the last STEP in the others. A place past the end is n.
    """
    m = 1 + max(0, -(-(n - WIDTH) // STEP))
    places = np.arange(m)[:, None] * STEP + np.arange(WIDTH)
    scored = places < n
    scored[1:, :HEAD] = False
    return np.minimum(places, n), scored


def many_windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`windows` of texts that lie one after another, each with a start before it."""
    counts = 1 + np.maximum(0, -(-(sizes - WIDTH) // STEP))
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    which = np.repeat(np.arange(len(sizes)), counts)
    turn = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    places = turn[:, None] * STEP + np.arange(WIDTH)
    scored = places < sizes[which, None]
    scored[turn > 0, :HEAD] = False
    return np.minimum(places, sizes[which, None]) + begin[which, None], scored


_DISTANCE = np.arange(WIDTH)[:, None] - np.arange(WIDTH)
_MASK = np.where(_DISTANCE >= 0, _F(0), _F(-1e9))
_PARTS = (("q", (K, DIM)), ("k", (K, DIM)), ("v", (K, K)), ("near", (WIDTH,)), ("bias", (K,)))


class Model:
    """log P, and the attention: queries and keys (K x DIM), values (K x K), a bias by distance and one by component."""

    def __init__(self, log_p: np.ndarray, gate: dict[str, np.ndarray], state: dict | None = None):
        self.log_p, self.gate, self.state = log_p, gate, state or {}  # state: of Adagrad
        self.odds = np.clip(log_p - log_p.mean(1, keepdims=True), -ODDS, ODDS)

    @staticmethod
    def start(rng: np.random.Generator) -> dict[str, np.ndarray]:
        small = lambda shape: (0.1 * rng.standard_normal(shape)).astype(_F)
        return {"q": small((K, DIM)), "k": small((K, DIM)), "v": np.eye(K, dtype=_F) * 3, "near": np.zeros(WIDTH, _F), "bias": np.zeros(K, _F)}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.gate[name].ravel() for name, _ in _PARTS]).astype(np.float64)

    @staticmethod
    def gate_of(flat: np.ndarray) -> dict[str, np.ndarray]:
        parts = np.split(np.asarray(flat, _F), np.cumsum([int(np.prod(shape)) for _, shape in _PARTS])[:-1])
        return {name: part.reshape(shape) for (name, shape), part in zip(_PARTS, parts, strict=True)}

    def words(self, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(embeddings, log S) of words; `begin` are the places in `ids` at which they begin."""
        sizes = np.diff(begin, append=len(ids))[:, None]
        return np.add.reduceat(self.odds[ids], begin, axis=0) / sizes.astype(_F), np.add.reduceat(self.log_p[ids], begin, axis=0)

    def _attention(self, e: np.ndarray, first: int) -> np.ndarray:
        g = self.gate
        s = np.matmul((e[:, first:] @ g["q"]) * _F(1 / np.sqrt(DIM)), (e @ g["k"]).transpose(0, 2, 1))
        s += (_MASK + g["near"][np.maximum(_DISTANCE, 0)])[first:]
        s -= s.max(-1, keepdims=True)
        np.exp(s, out=s)
        s *= 1 / s.sum(-1, keepdims=True)
        return s

    def gates(self, e: np.ndarray, first: int = 0) -> np.ndarray:
        """Gate of each place from `first` on, given the embeddings of windows (n x WIDTH x K)."""
        z = np.matmul(self._attention(e, first), e @ self.gate["v"])
        z += self.gate["bias"]
        z -= z.max(-1, keepdims=True)
        np.exp(z, out=z)
        z *= 1 / z.sum(-1, keepdims=True)
        return z

    def scored_gates(self, e: np.ndarray, places: np.ndarray, scored: np.ndarray, batch: int = 1024) -> np.ndarray:
        """Gates of all scored places in order of row and place; `e` is what `places` index."""
        out = np.empty((int(scored.sum()), K), _F)
        at = np.cumsum(scored.ravel()).reshape(scored.shape) - 1
        whole = scored[:, 0]
        for rows, first in ((np.nonzero(whole)[0], 0), (np.nonzero(~whole)[0], HEAD)):
            for k in range(0, len(rows), batch):
                some = rows[k : k + batch]
                keep = scored[some, first:]
                out[at[some, first:][keep]] = self.gates(e[places[some]], first)[keep]
        return out

    def learn(self, e: np.ndarray, likely: np.ndarray, scored: np.ndarray, rate: float = RATE) -> np.ndarray:
        """One Adagrad step of the attention on windows (`e` and exp(log S - max), n x WIDTH x K); the posterior of each scored word."""
        g = self.gate
        att = self._attention(e, 0)
        mixed = np.matmul(att, e)
        z = mixed @ g["v"]
        z += g["bias"]
        z -= z.max(-1, keepdims=True)
        np.exp(z, out=z)
        z *= 1 / z.sum(-1, keepdims=True)
        joint = z * likely
        joint *= 1 / joint.sum(-1, keepdims=True)
        posterior = joint[scored]
        if rate:
            joint -= z
            joint *= scored[..., None] * _F(1 / max(1, len(posterior)))  # gradient of the log-likelihood by the gate's input
            flat = joint.reshape(-1, K)
            grads = {"bias": flat.sum(0), "v": mixed.reshape(-1, K).T @ flat}
            d = np.matmul(joint @ g["v"].T, e.transpose(0, 2, 1))
            d -= (att * d).sum(-1, keepdims=True)
            d *= att
            grads["near"] = np.bincount(np.maximum(_DISTANCE, 0).ravel(), (d.sum(0) * (_DISTANCE >= 0)).ravel(), WIDTH)
            flat = e.reshape(-1, K).T * _F(1 / np.sqrt(DIM))
            grads["q"] = flat @ np.matmul(d, e @ g["k"]).reshape(-1, DIM)
            grads["k"] = flat @ np.matmul(d.transpose(0, 2, 1), e @ g["q"]).reshape(-1, DIM)
            for name, grad in grads.items():
                self.state[name] = self.state.get(name, 1e-8) + grad**2
                g[name] = (g[name] + rate * grad / np.sqrt(self.state[name])).astype(_F)
        return posterior


def fit(texts: list[np.ndarray], vocabulary: int, start: int, begins: np.ndarray, rounds: int = 20, steps: int = 200, seed: int = 7) -> Model:
    """P and the attention from sample texts (arrays of ids); `begins` marks the ids that begin a word.

    P is that of a mixture of whole texts, so its components are languages or
    kinds of text; the attention then learns to tell them from the context.
    """
    rng = np.random.default_rng(seed)
    texts = [t for t in texts if len(t)] or [np.array([start])]
    sizes = np.array([len(t) for t in texts])
    ids, of_text = np.concatenate(texts), np.repeat(np.arange(len(texts)), sizes)
    share = rng.dirichlet(np.ones(K), len(texts))
    for r in range(rounds):
        of = np.stack([np.bincount(ids, share[of_text, k], minlength=vocabulary) for k in range(K)], axis=1)
        log_p = table(of)
        prior = np.log(share.sum(0) + 1)
        z = np.add.reduceat(log_p[ids].astype(np.float64), np.cumsum(sizes) - sizes, axis=0)
        z = (z - z.max(1, keepdims=True)) * min(1.0, 0.02 + r / rounds) + prior  # softened at first
        share = np.exp(z - z.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
    model = Model(log_p, Model.start(rng))
    begin = np.nonzero(begins[ids])[0]
    if not len(begin) or begin[0]:
        begin = np.concatenate([[0], begin])
    e, s = model.words(ids, begin)
    e0 = model.odds[start][None]
    counts = np.bincount(of_text[begin], minlength=len(texts))
    parts = np.split(np.arange(len(begin)), np.cumsum(counts)[:-1])
    embed = np.concatenate([x for p in parts for x in (e0, e[p])])
    likely = np.concatenate([x for p in parts for x in (s[p], s[:1])])  # the word after each place
    likely = np.exp(likely - likely.max(1, keepdims=True))
    places, scored = many_windows(counts)
    for _ in range(steps):
        pick = rng.integers(0, len(places), 128)
        model.learn(embed[places[pick]], likely[places[pick]], scored[pick])
    return model
