"""Huge JSON arrays in blocks of any size."""

import json
import random

from hypothesis import given, settings, strategies as st

from memlake.sources import exports, json_array as J

VALUES = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(-9, 99), st.text(alphabet='a"\\[]{},é \n:', max_size=8)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text(alphabet='a"\\[', max_size=3), x, max_size=3)), max_leaves=8)


def by_blocks(data, block):
    """What the Spark jobs do, in a loop: states of blocks from their changes, then each block's elements."""
    lows = range(0, len(data), block)
    state, depth, out = J.OUT, 0, []
    for low in lows:
        high = min(low + block, len(data))
        out += [x for _, x in J.elements(lambda a, b: data[a:b], len(data), low, high, state, depth, block)]
        state, deeper = J.change(data[low:high])[state][0], J.change(data[low:high])[state][1]
        depth += deeper
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(VALUES, max_size=6), st.integers(1, 40), st.booleans(), st.sampled_from([None, 1]))
def test_elements_whatever_the_blocks(values, block, ascii_only, indent):
    data = json.dumps(values, ensure_ascii=ascii_only, indent=indent).encode()
    assert [json.loads(x) for x in by_blocks(data, block)] == values


def test_one_file_in_many_tasks(spark, tmp_path, monkeypatch):
    """An export of one list: the same nodes as read whole, a broken conversation left out, and blocks far smaller than the file."""
    rng = random.Random(3)
    talk = lambda i: {"uuid": f"c{i}", "name": 'a "[', "created_at": "2024", "updated_at": "2024", "chat_messages": [{"uuid": f"m{i}-{n}", "sender": "human", "text": "x" * rng.randint(0, 90) + '\\"]},{["', "created_at": str(n), "parent_message_uuid": f"m{i}-{n - 1}" if n else ""} for n in range(3)]}
    talks = [talk(i) for i in range(200)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(talks[:150] + ["no conversation", {"uuid": 5, "chat_messages": "none"}, 7] + talks[150:], indent=1))
    (tmp_path / "in" / "b.json").write_text("[]")
    found = J.read_elements(spark, str(tmp_path / "in"), block=1000)
    assert found.count() == 203 and found.rdd.getNumPartitions() > 1
    whole = exports.read_tree_array(spark, str(tmp_path / "in")).select("conv_id", "id", "parent_id", "ord", "text")
    got = sorted(map(tuple, whole.where("conv_id <> '5'").collect()))
    assert got == sorted((t["uuid"], m["uuid"], m["parent_message_uuid"] or None, n, m["text"]) for t in talks for n, m in enumerate(t["chat_messages"]))
