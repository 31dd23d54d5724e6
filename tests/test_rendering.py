"""Rendered results against a plain walk over a small result list."""

from tidemark.operators import rendering


def walk(found, entries):
    """The texts, question by question, as one would write them by hand."""
    out = {}
    for q in sorted({f[0] for f in found}):
        rows = sorted(((s, e) for k, e, s in found if k == q and e in entries), key=lambda x: (-x[0], x[1]))
        core, context, archive = [], [], []
        for score, e in rows:
            if score >= 0.7 and len(core) < 3:
                core.append((score, e))
            elif score >= 0.35 and len(context) < 5:
                context.append((score, e))
            else:
                archive.append((score, e))
        title, content = (lambda e: entries[e][0] or ""), (lambda e: entries[e][1] or "")
        system = "\n".join([rendering.SYSTEM_HEAD] + [f"\n记忆{i} (共振: {s:.0%}): {content(e)}" for i, (s, e) in enumerate(core, 1)]) if core else ""
        lines = ["[相关记忆]"] * bool(core) + [f"• {title(e)}: {content(e)[:200]}" for _, e in core] + [f"• {title(e)}: {content(e)[:150]}" for _, e in context]
        old = "\n".join(["[历史参考]"] + [f"· {title(e)} ({entries[e][2]})" for _, e in archive[:10]]) if archive else ""
        whole = "\n".join(t for t in (system, "\n".join(lines), old) if t)
        tokens, base = len(whole) // 2, len("\n".join(content(e) for _, e in rows)) // 2
        if rows:
            out[q] = (len(core), len(context), len(archive), system, "\n".join(lines), old, tokens, base, max(0.0, round((1 - tokens / base) * 100, 1)) if base else 0.0)
    return out


def test_rendered(spark):
    days = {n: f"01-{1 + n % 28:02d}" for n in range(40)}
    entries = {n: (None if n == 3 else f"title {n}", None if n == 4 else "汉字 long " * (n * 9), days[n]) for n in range(40)}
    found = [(1, n, 0.95 - n * 0.03) for n in range(25)] + [(2, n, 0.5) for n in (7, 5, 6)] + [(3, n, 0.1) for n in range(13)] + [(4, 4, 0.8), (5, 999, 0.9), (6, 8, 0.625), (6, 9, 0.875)]
    rows = spark.createDataFrame([(n, t, c, 1704067200 + (n % 28) * 86400, "x") for n, (t, c, _) in entries.items()], "entry_id long, title string, content string, created_at long, stage string")
    got = rendering.rendered(spark.createDataFrame(found, "question_id long, entry_id long, score double"), rows)
    want = walk(found, entries)
    assert {r.question_id: (r.n_core, r.n_context, r.n_archive, r.system, r.context, r.archive, r.tokens, r.baseline_tokens, r.saved) for r in got.collect()} == want
    assert rendering.rendered(spark.createDataFrame([], "question_id long, entry_id long, score double"), rows).count() == 0
