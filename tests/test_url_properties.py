"""Property test: IPv4-looking hosts in many spellings, screened by Spark,
against a direct Python statement of the WHATWG IPv4 parser rules."""

from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.functions import url as U


def _number(part: str):
    if part == "":
        return None
    if part[:2].lower() == "0x":
        digits, base = part[2:], 16
    elif len(part) > 1 and part[0] == "0":
        digits, base = part[1:], 8
    else:
        digits, base = part, 10
    if digits == "":
        return 0
    try:
        return int(digits, base)
    except ValueError:
        return None


def whatwg_reason(host: str):
    labels = host.split(".")
    if len(labels) > 1 and labels[-1] == "":
        labels = labels[:-1]
    last = labels[-1]
    ends_in_number = last != "" and (last.isdigit() or _number(last) is not None and last[:2].lower() == "0x")
    if not ends_in_number:
        return None  # an ordinary name here (all names below are public)
    nums = [_number(p) for p in labels]
    if any(n is None for n in nums) or len(nums) > 4 or any(n > 255 for n in nums[:-1]) \
            or nums[-1] >= 256 ** (5 - len(nums)):
        return U.REASON_INVALID
    addr = 0
    for n in nums[:-1]:
        addr = addr * 256 + n
    addr = addr * 256 ** (5 - len(nums)) + nums[-1]
    a, b = addr >> 24, (addr >> 16) & 255
    private = (a in (0, 10, 127) or a >= 224 or (a == 169 and b == 254) or (a == 172 and 16 <= b <= 31)
               or (a == 192 and b == 168) or (a == 100 and 64 <= b <= 127))
    return U.REASON_PRIVATE if private else None


def spell(n: int, style: int) -> str:
    return [str(n), hex(n), "0" + oct(n)[2:], "0X" + format(n, "X")][style]


part = st.tuples(st.integers(0, 300), st.integers(0, 3))
host = st.one_of(
    st.lists(part, min_size=1, max_size=5).map(lambda ps: ".".join(spell(n, s) for n, s in ps)),
    st.tuples(st.integers(0, 2 ** 32 + 5), st.integers(0, 3)).map(lambda t: spell(*t)),
    st.sampled_from(["09.1.1.1", "1..2", "example.com", "0x", "1.2.3.4.", "a.1", "10.0.0.08"]),
)


@settings(max_examples=3, deadline=None)
@given(st.lists(host, min_size=120, max_size=120))
def test_ipv4_hosts(spark, hosts):
    df = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(hosts)], "i int, u string")
    out = U.with_url_screen(df, "u", prefix="").collect()
    for r in out:
        h = hosts[r["i"]]
        assert r["reason"] == whatwg_reason(h), (h, r["reason"])
