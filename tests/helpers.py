from __future__ import annotations

from signalspark.operators import fields as fd

FRAMES = "session_id string, arb_id long, t_mono double, row_seq long, data binary, direction string"


def frames(spark, payloads, arb_id=0x3C0, step=0.02, session="s", times=None):
    rows = [
        (session, arb_id, float(times[i] if times else i * step), i, bytes(p), "rx") for i, p in enumerate(payloads)
    ]
    return spark.createDataFrame(rows, FRAMES)


def steps(df, **kw):
    return fd.frame_steps(fd.frame_history(df, **kw))
