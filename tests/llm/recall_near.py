"""python tests/llm/recall_near.py FOLDER: recall of near duplicates on FOLDER/documents.parquet, against brute force.

Every text whose document id is divisible by 50 is held against all others by an index of all shingles. A link is found if both
texts are of one class.
"""

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


def main(folder: str) -> None:
    import numpy as np
    from pyspark.sql import SparkSession

    from weftline.llm import near

    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    root = {r.doc_id: bytes(r.root) for r in near.near_classes(docs).collect()}
    texts: dict[str, int] = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r.text or "", r.doc_id)
    ids = np.array(list(texts.values()))
    sets = [near.shingles(t.encode()) for t in texts]
    owner = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    flat = np.concatenate([h for h, _ in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    links = found = exact_links = exact_found = 0
    for q in np.flatnonzero(ids % 50 == 0):
        h = sets[q][0]
        low, high = np.searchsorted(flat, h, "left"), np.searchsorted(flat, h, "right")
        common = np.bincount(np.concatenate([owner[x:y] for x, y in zip(low, high)] or [np.empty(0, np.int64)]), minlength=len(sets))
        for k in np.flatnonzero(common >= 0.4 * max(1, len(h))):
            if k != q and near.similarity(sets[q], sets[k]) >= 0.8:
                plain = common[k] / (len(h) + len(sets[k][0]) - common[k]) >= 0.8
                same = root[ids[q]] == root[ids[k]]
                links, found, exact_links, exact_found = links + 1, found + same, exact_links + plain, exact_found + (plain and same)
    print(f"{len(ids)} texts, {int((ids % 50 == 0).sum())} queries: {found} of {links} links of 0.8 by either measure, {exact_found} of {exact_links} by plain Jaccard")


if __name__ == "__main__":
    main(sys.argv[1])
