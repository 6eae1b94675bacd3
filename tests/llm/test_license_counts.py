"""Licenses are counted over the whole template."""

import random

from conftest import prose

from specval.llm import licenses


def test_license_with_changed_words_is_counted_over_the_whole_template(spark):
    header, line = licenses.TEMPLATES["GPL header"], licenses.TEMPLATES["GPL-3.0"]
    changed = [header.replace("version 3 of the License", "version 2 of the License"), header.replace("GNU General", "GNU Lesser General"),
               line.replace("This work", "The work"), header.replace("redistribute", "share").replace("Foundation", "Group").replace("option", "choice")]
    texts = [f"{prose(random.Random(k), 40 + k)} {t}\n{prose(random.Random(-k - 1), 30)}" for k, t in enumerate(changed)]
    wanted = {}
    for k, text in enumerate(texts):
        w = licenses.words_of(text)
        for name, template in licenses.TEMPLATES.items():
            t = licenses.words_of(template)
            width = min(5, len(t))
            all_ = set(licenses.shingles(t, width))
            share = len(all_ & set(licenses.shingles(w, width))) / len(all_)
            if share >= 0.8:
                wanted[k, name] = share
    out = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["license"]): r["containment"] for r in out} == wanted
    assert {(0, "GPL header"), (1, "GPL header"), (2, "GPL-3.0")} <= set(wanted) and (3, "GPL header") not in wanted
