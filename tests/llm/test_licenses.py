"""The license join against brute force, with wrapped notices."""

import math
import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
MIT = " * Permission is hereby granted, free of charge, to any person obtaining\n * a copy of this software and associated\n *\n * documentation files"


def plain(text, templates, threshold=0.9):
    """labels and score: every stretch of each notice's span against every template."""
    words = WORD.findall(text.lower())
    labels, score = set(), 0.0
    for label, notices in templates.items():
        for notice in notices:
            span, whole = math.ceil(len(notice.split()) / threshold - 1e-9), set(notice.split())
            blocks = [words[i : i + span] for i in range(max(1, len(words) - span + 1))]
            held = max(len(whole & set(b)) for b in blocks)
            if held >= math.ceil(threshold * len(whole) - 1e-9):
                labels.add(label)
                score = max(score, held / len(whole))
    return ",".join(sorted(labels)), score


def test_wrapped_notices(spark):
    from palisade.llm.licenses import TEMPLATES, scan_licenses
    from palisade.session import ship

    rnd = random.Random(3)
    vocabulary = [w for notices in TEMPLATES.values() for n in notices for w in n.split()] + ["gadget", "lorem", "vivid", "ocean"]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    texts = [BSD, MIT, f"{prose(5)}\n{BSD}\n{prose(5)}", "licensed\nunder the\n\nmpl", "all rights reserved\nno part of this publication\nmay be reproduced"]
    for notice in (n for notices in TEMPLATES.values() for n in notices):
        for change in range(8):  # wrapped, with words dropped, doubled, added or moved far away
            words = notice.split()
            for _ in range(change // 2):
                i = rnd.randrange(len(words))
                words[i : i + 1] = rnd.choice([[], [words[i]] * 2, [words[i], "gadget"]])
                words = words or ["x"]
            if change == 7:
                words[len(words) // 2 : len(words) // 2] = prose(40).split()
            texts.append(prose(rnd.randrange(12)) + " " + "".join(w + rnd.choice([" ", " ", "\n", "\n# "]) for w in words) + prose(rnd.randrange(12)))
    texts += [prose(300) for _ in range(10)] + ["", None]
    ship(spark)
    rows = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert rows[0].labels == "bsd" and rows[1].labels == "mit" and rows[0].score == rows[1].score == 1
    for i, text in enumerate(texts):
        labels, score = plain(text or "", TEMPLATES)
        base = set(filter(None, rows[i].base_labels.split(",")))
        assert rows[i].labels == ",".join(sorted(base | set(filter(None, labels.split(",")))))
        assert rows[i].score == (1 if base else score)


def test_scattered_words(spark):
    """A notice's words far apart in one line are no notice; a wrapped notice in a line of 5,000 words is."""
    from palisade.llm.licenses import scan_licenses
    from palisade.session import ship

    ship(spark)
    rnd = random.Random(2)
    filler = lambda n: [rnd.choice(["gadget", "lorem", "vivid", "ocean", "this", "to", "in"]) for _ in range(n)]
    scattered = lambda parts: " ".join(w for part in parts for w in [*filler(100), *part.split()])
    far = [scattered(["reserved", "all rights", "no part", "publication", "may be reproduced", "of"]), scattered(["permission is", "hereby granted", "free of charge", "to any person obtaining a copy", "of this software and associated", "documentation files"])]
    near = " ".join(filler(2500)) + " " + MIT.replace("\n", " ") + " " + " ".join(filler(2500))
    got = {r.doc_id: (r.labels, r.score) for r in scan_licenses(spark.createDataFrame(list(enumerate([*far, near])), "doc_id int, text string")).collect()}
    assert got == {0: ("", 0.0), 1: ("", 0.0), 2: ("mit", 1.0)}
