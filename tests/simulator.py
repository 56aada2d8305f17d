"""A plain sequential simulation of the transfer graph, to hold the plans against."""

from __future__ import annotations

from collections import defaultdict

from ledgerflow.schema import Config


class Simulator:
    def __init__(self, cfg: Config = Config()):
        self.cfg = cfg
        self.out, self.inn = defaultdict(list), defaultdict(list)  # (m, peer, seq, amount, ach)
        self.first, self.total_out, self.total = {}, defaultdict(int), defaultdict(int)
        self.edges = []
        self.linked, self.rebuilt = [], None
        self.members: dict = {}

    def link(self, src, dst):
        """Both accounts and all that hang on either are one set."""
        both = self.members.get(src, {src}) | self.members.get(dst, {dst})
        for x in both:
            self.members[x] = both

    def live(self, side, acct, now):
        return [x for x in side[acct][-self.cfg.cap :] if x[0] >= now - self.cfg.window]

    def cycle(self, seq, m, src, dst):
        """Length of the shortest cycle that the transfer closes, by breadth-first search over bounds, over edges that both accounts' lists hold."""
        held = lambda side, acct: {x[2] for x in side[acct][-self.cfg.cap :]}
        state = {src: m}
        for hop in range(1, self.cfg.cycle_max_len):
            nxt = {}
            for node, bound in state.items():
                for s, t, a, b in self.edges:
                    if b == node and s < seq and t <= bound and t >= m - self.cfg.window and s in held(self.inn, b) and s in held(self.out, a):
                        if a == dst:
                            return hop + 1
                        if a != src:
                            nxt[a] = max(nxt.get(a, -1), t)
            state = nxt
        return 0

    def step(self, seq, m, src, dst, amount, ach):
        cfg = self.cfg
        for a in (src, dst):
            self.first.setdefault(a, m)
        if self.rebuilt is None or m - self.rebuilt >= cfg.ring_rebuild:
            self.rebuilt = m
            self.linked = [e for e in self.linked if e[1] >= m - cfg.window]
            self.members = {}
            for _, _, a, b in self.linked:
                self.link(a, b)
        if src == dst:
            return None
        self.out[src].append((m, dst, seq, amount, ach))
        self.inn[dst].append((m, src, seq, amount, ach))
        self.total_out[src] += 1
        self.total[src] += 1
        self.total[dst] += 1
        so, si, di, do = self.live(self.out, src, m), self.live(self.inn, src, m), self.live(self.inn, dst, m), self.live(self.out, dst, m)
        n = lambda xs: len({x[1] for x in xs})
        f = {"src_out": n(so), "src_in": n(si), "dst_in": n(di), "dst_out": n(do), "src_history": self.total[src], "dst_history": self.total[dst]}
        f["pair_repeat"] = sum(x[1] == dst and x[2] != seq for x in so)
        f["sent_24h"] = sum(x[0] >= m - cfg.velocity_window for x in so)
        f["got_24h"] = sum(x[0] >= m - cfg.velocity_window for x in di)
        f["velocity_ratio"] = f["sent_24h"] / (self.total_out[src] / max((m - self.first[src]) / 1440, 1.0))
        f["src_ach_share"] = sum(x[4] for x in so) / len(so)
        f["dst_ach_share"] = sum(x[4] for x in di) / len(di)
        f["pass_gap"] = None
        for x in reversed(si):
            if x[0] >= m - cfg.pass_lookback and x[1] != dst and x[3] > 0 and 1 - cfg.pass_max_skim <= amount / x[3] <= 1 + 1e-6:
                f["pass_gap"] = m - x[0]
                break
        senders = {x[1] for x in di if x[1] != src}
        best, seen = 0, []
        for x in reversed(si):
            if x[1] == dst or x[1] in seen:
                continue
            seen.append(x[1])
            if len(seen) > cfg.sg_branch:
                break
            mids = {o[1] for o in self.live(self.out, x[1], m)} & senders - {src}
            best = max(best, len(mids))
        f["paths"] = best + 1 if best else 0
        f["cycle_len"] = self.cycle(seq, m, src, dst)
        self.edges.append((seq, m, src, dst))
        hit = f["src_out"] >= cfg.fan_threshold or f["dst_in"] >= cfg.fan_threshold or f["paths"] >= cfg.sg_min_paths
        hit = hit or min(f["src_in"], f["src_out"]) >= cfg.gs_min_degree or f["cycle_len"] > 0 or (f["pass_gap"] is not None and f["pass_gap"] <= cfg.pass_window)
        if hit and len(so) + len(si) <= cfg.hub_degree and len(do) + len(di) <= cfg.hub_degree:
            self.linked.append((seq, m, src, dst))
            self.link(src, dst)
        f["ring_size"] = len(self.members.get(src, ()))
        f["ring_members"] = sorted(self.members.get(src, ()))
        f["ring_evidence"] = [s for s, _, a, _ in self.linked if a in self.members.get(src, ())][-self.cfg.evidence_cap :]
        f["ring_id"] = min((s for s, _, a, _ in self.linked if a in self.members.get(src, ())), default=None)
        return f
