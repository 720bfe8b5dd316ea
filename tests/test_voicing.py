import random

from pyspark.sql import functions as F

from ritardo.operators.music import voicing_summary


def test_means_do_not_depend_on_the_order_of_the_onsets(spark):
    """The mean is -127/128, on the border of six places; thirds make its sum depend on the order."""
    r = random.Random(0)
    thirds = [3 * r.randint(-20, 20) + 1 for _ in range(3)]
    six = [2 * x for x in thirds] + [6 * r.randint(-90, 90) for _ in range(60)]
    six.append(-381 - sum(six))  # sixths: the sum is -63.5
    x = [v / 6 for v in six]
    orders = {}
    while len(orders) < 2:  # one order whose sum falls short of the border, one that does not
        r.shuffle(x)
        total = 0.0
        for v in x:
            total += v
        orders[abs(total) < 63.5] = list(x)
    for order in orders.values():
        df = spark.createDataFrame([(1, v, v) for v in order], "k long, vel_diff double, lead_ms double")
        s = voicing_summary(df.coalesce(1), ["k"]).select(
            "n_onsets", F.round("vel_diff_mean", 6), F.round("lead_mean_ms", 6)).first()
        assert tuple(s) == (64, -0.992188, -0.992188)
