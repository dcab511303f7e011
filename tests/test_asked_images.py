from mendline.operators import lookup


def test_only_the_images_that_are_asked_for(spark):
    images = spark.createDataFrame(
        [("E", k, f'{{"lastModifiedEpochMs":{100 * k + v}}}') for k in range(50) for v in (0, 1)] + [("F", 3, "{}"), (None, 4, "{}"), ("E", None, "{}")],
        "entity_type string, record_id bigint, image string")
    commands = spark.createDataFrame([("E", 3, "a", 1), ("E", 3, "b", 2), ("E", 99, "c", 3), ("F", 3, "d", 4), (None, 4, "e", 5), ("E", None, "f", 6)],
                                     "entity_type string, record_id bigint, event_id string, seq bigint")
    asked = lookup.asked_images(commands, images)
    assert sorted((r.entity_type, r.record_id) for r in asked.collect()) == [("E", 3), ("E", 3), ("F", 3)]
    rows = lambda found: sorted(map(str, lookup.fill_lookup(commands, found).collect()))
    assert rows(asked) == rows(images) and len(rows(asked)) == 6
