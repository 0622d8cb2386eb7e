"""Dense brute-force scoring in pandas, written straight from the formulas,
independent of the Spark plans.  Small fixtures only."""

from __future__ import annotations

import pandas as pd


class DenseModel:
    def __init__(self, vocab: pd.DataFrame, bigrams: pd.DataFrame, trigrams: pd.DataFrame):
        self.vocab = vocab.set_index("idx").sort_index()
        self.V = len(self.vocab)
        self.p = self.vocab["prob"]
        self.bi = {(r.wi_1, r.wi): r.count for r in bigrams.itertuples()}
        self.tri = {(r.wi_2, r.wi_1, r.wi): r.count for r in trigrams.itertuples()}
        self.a2 = bigrams.groupby("wi_1")
        self.a3 = trigrams.groupby(["wi_2", "wi_1"])
        self.bi_by_v = {k: g for k, g in self.a2}
        self.tri_by_ctx = {k: g for k, g in self.a3}

    def stupid(self, u, v, a=0.4):
        s = pd.Series(a * a * self.p.values, index=self.p.index)
        g = self.bi_by_v.get(v)
        if g is not None:
            s.loc[g.wi.values] = a * g["count"].values / g["count"].sum()
        g3 = self.tri_by_ctx.get((u, v))
        if g3 is not None:
            s.loc[g3.wi.values] = g3["count"].values / g3["count"].sum()
        return s

    def katz2(self, v, d=0.5):
        g = self.bi_by_v.get(v)
        if g is None:
            return self.p.copy()
        t2 = g["count"].sum()
        alpha = 1 - ((g["count"] - d) / t2).sum()
        seen = set(g.wi.values)
        b = [i for i in self.p.index if i not in seen]
        q = pd.Series(0.0, index=self.p.index)
        if b:
            q.loc[b] = alpha * self.p.loc[b] / self.p.loc[b].sum()
        q.loc[g.wi.values] = (g["count"].values - d) / t2
        return q

    def katz(self, u, v, d=0.5):
        q2 = self.katz2(v, d)
        g3 = self.tri_by_ctx.get((u, v))
        if g3 is None:
            return q2 / q2.sum()
        t3 = g3["count"].sum()
        alpha = 1 - ((g3["count"] - d) / t3).sum()
        seen = set(g3.wi.values)
        b = [i for i in self.p.index if i not in seen]
        denom = q2.loc[b].sum()
        s = alpha * q2 / denom
        s.loc[g3.wi.values] = (g3["count"].values - d) / t3
        return s

    def top(self, u, v, algo="stupid", k=10, exclude=()):
        s = self.stupid(u, v) if algo == "stupid" else self.katz(u, v)
        s = s.drop(index=[i for i in exclude if i in s.index])
        r = s.rank(method="min", ascending=False)
        return {int(i): float(x) for i, x in s[r <= k].items()}
