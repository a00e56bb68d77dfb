"""CLI: python tests/check_all.py [sf_dir] [name ...] -> per-query oracle match."""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harness import compare, duck  # noqa: E402
from protea.session import local_session  # noqa: E402
import __spark_entry__ as E  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:] or sorted(E.queries())
spark = local_session(8)
con = duck(sf)
bad = 0
for n in names:
    t = time.time()
    try:
        r = compare(spark, n, sf, con)
    except Exception as e:  # report and continue
        r = {"name": n, "error": repr(e)[:400]}
    r["sec"] = round(time.time() - t, 2)
    ok = r.get("values_match", r.get("oracle") is False and "error" not in r)
    bad += not ok
    print(("OK  " if ok else "BAD ") + str(r), flush=True)
print("failures:", bad)
