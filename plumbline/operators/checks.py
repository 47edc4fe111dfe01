"""The catalogue of checks: a sensor, a rule, default thresholds, a category.

A check is data. The catalogue lists what each check type measures, how the
reading is graded and which quality dimension the grade counts towards.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from plumbline import fixed


@dataclass(frozen=True)
class CheckType:
    name: str
    sensor: str
    rule: str
    category: str
    thresholds: dict[str, float] = field(default_factory=dict)

    @property
    def dimension(self) -> str | None:
        """Dimension the check is scored in, None when it is not scored."""
        if self.category == "anomaly":
            return None
        return fixed.DIMENSION_OF_CHECK.get(self.name) or fixed.CATEGORY_DIMENSION.get(self.category)


# --- Fixed values: check type, sensor, rule, category, default thresholds ----------
# The nine *_match checks measure the named sensor on two sources.

_CATALOGUE = """
row_count                                  row_count                              min_max_count       volume            min_count=1
column_count                               column_count                           min_max_count       schema
column_count_changed                       column_count                           not_equal_to        schema
data_staleness                             data_staleness                         max_value           timeliness        max_value=86400
table_availability                         table_availability                     is_true             availability
duplicate_record_count                     duplicate_record_count                 max_count           uniqueness        max_count=0
duplicate_record_percent                   duplicate_record_percent               max_percent         uniqueness        max_percent=0.0
sql_condition_failed_on_table              sql_condition_failed_count             max_count           custom_sql        max_count=0
sql_aggregate_expression_on_table          sql_aggregate_value                    min_max_value       custom_sql
sql_condition_passed_percent_on_table      sql_condition_passed_percent           min_percent         custom_sql        min_percent=95.0
sql_invalid_record_count_on_table          sql_invalid_record_count               max_count           custom_sql        max_count=0
column_list_changed                        column_list_hash                       not_equal_to        schema            forbidden_value=1
column_list_or_order_changed               column_list_or_order_hash              not_equal_to        schema            forbidden_value=1
column_types_changed                       column_types_hash                      not_equal_to        schema            forbidden_value=1
reload_lag                                 reload_lag                             max_value           timeliness        max_value=86400
import_custom_result_on_table              import_custom_result_on_table          min_max_value       custom_sql
nulls_count                                nulls_count                            max_count           nulls             max_count=0
nulls_percent                              nulls_percent                          max_percent         nulls             max_percent=5.0
not_nulls_count                            not_nulls_count                        min_count           nulls             min_count=1
not_nulls_percent                          not_nulls_percent                      min_percent         nulls             min_percent=95.0
empty_column_found                         nulls_percent                          max_percent         nulls             max_percent=99.99
distinct_count                             distinct_count                         min_max_count       uniqueness
distinct_percent                           distinct_percent                       min_max_percent     uniqueness
duplicate_count                            duplicate_count                        max_count           uniqueness        max_count=0
duplicate_percent                          duplicate_percent                      max_percent         uniqueness        max_percent=0.0
min_in_range                               min_value                              min_max_value       numeric
max_in_range                               max_value                              min_max_value       numeric
sum_in_range                               sum_value                              min_max_value       numeric
mean_in_range                              mean_value                             min_max_value       numeric
median_in_range                            median_value                           min_max_value       numeric
number_below_min_value                     min_value                              min_value           numeric
number_above_max_value                     max_value                              max_value           numeric
number_in_range_percent                    number_in_range_percent                min_percent         numeric           min_percent=95.0
text_min_length                            text_min_length                        min_max_value       text
text_max_length                            text_max_length                        min_max_value       text
text_mean_length                           text_mean_length                       min_max_value       text
text_length_below_min_length               text_length_below_min                  max_count           text              max_count=0
text_length_above_max_length               text_length_above_max                  max_count           text              max_count=0
text_length_in_range_percent               text_length_in_range_percent           min_percent         text              min_percent=95.0
empty_text_found                           empty_text_count                       max_count           text              max_count=0
whitespace_text_found                      whitespace_text_count                  max_count           text              max_count=0
text_not_matching_regex_found              regex_not_match_count                  max_count           text              max_count=0
empty_text_percent                         empty_text_percent                     max_percent         text              max_percent=0.0
whitespace_text_percent                    whitespace_text_percent                max_percent         text              max_percent=0.0
null_placeholder_text_found                null_placeholder_text_count            max_count           text              max_count=0
null_placeholder_text_percent              null_placeholder_text_percent          max_percent         text              max_percent=0.0
text_surrounded_by_whitespace_found        text_surrounded_whitespace_count       max_count           text              max_count=0
text_surrounded_by_whitespace_percent      text_surrounded_whitespace_percent     max_percent         text              max_percent=0.0
texts_not_matching_regex_percent           regex_not_match_percent                max_percent         text              max_percent=5.0
text_matching_regex_percent                regex_match_percent                    min_percent         text              min_percent=95.0
min_word_count                             text_word_count_min                    min_max_value       text
max_word_count                             text_word_count_max                    min_max_value       text
valid_latitude_percent                     valid_latitude_percent                 min_percent         geographic        min_percent=95.0
valid_longitude_percent                    valid_longitude_percent                min_percent         geographic        min_percent=95.0
number_below_min_value_percent             number_below_min_percent               max_percent         numeric           max_percent=0.0
number_above_max_value_percent             number_above_max_percent               max_percent         numeric           max_percent=0.0
negative_values                            negative_value_count                   max_count           numeric           max_count=0
negative_values_percent                    negative_value_percent                 max_percent         numeric           max_percent=0.0
non_negative_values                        non_negative_value_count               min_count           numeric           min_count=1
non_negative_values_percent                non_negative_value_percent             min_percent         numeric           min_percent=95.0
integer_in_range_percent                   integer_in_range_percent               min_percent         numeric           min_percent=95.0
sample_stddev_in_range                     stddev_sample                          min_max_value       statistical
population_stddev_in_range                 stddev_population                      min_max_value       statistical
sample_variance_in_range                   variance_sample                        min_max_value       statistical
population_variance_in_range               variance_population                    min_max_value       statistical
percentile_in_range                        percentile                             min_max_value       statistical
percentile_10_in_range                     percentile_10                          min_max_value       statistical
percentile_25_in_range                     percentile_25                          min_max_value       statistical
percentile_75_in_range                     percentile_75                          min_max_value       statistical
percentile_90_in_range                     percentile_90                          min_max_value       statistical
text_length_below_min_length_percent       text_length_below_min_percent          max_percent         text              max_percent=5.0
text_length_above_max_length_percent       text_length_above_max_percent          max_percent         text              max_percent=5.0
invalid_email_format_found                 invalid_email_format_count             max_count           patterns          max_count=0
invalid_email_format_percent               invalid_email_format_percent           max_percent         patterns          max_percent=5.0
invalid_uuid_format_found                  invalid_uuid_format_count              max_count           patterns          max_count=0
invalid_uuid_format_percent                invalid_uuid_format_percent            max_percent         patterns          max_percent=5.0
invalid_ip4_format_found                   invalid_ip4_format_count               max_count           patterns          max_count=0
invalid_ip4_format_percent                 invalid_ip4_format_percent             max_percent         patterns          max_percent=5.0
invalid_ip6_format_found                   invalid_ip6_format_count               max_count           patterns          max_count=0
invalid_ip6_format_percent                 invalid_ip6_format_percent             max_percent         patterns          max_percent=5.0
invalid_usa_phone_format_found             invalid_phone_format_count             max_count           patterns          max_count=0
invalid_usa_phone_format_percent           invalid_phone_format_percent           max_percent         patterns          max_percent=5.0
invalid_usa_zipcode_format_found           invalid_zipcode_format_count           max_count           patterns          max_count=0
invalid_usa_zipcode_format_percent         invalid_zipcode_format_percent         max_percent         patterns          max_percent=5.0
contains_usa_phone_percent                 contains_phone_percent                 max_percent         pii               max_percent=0.0
contains_email_percent                     contains_email_percent                 max_percent         pii               max_percent=0.0
contains_usa_zipcode_percent               contains_zipcode_percent               max_percent         pii               max_percent=0.0
contains_ip4_percent                       contains_ip4_percent                   max_percent         pii               max_percent=0.0
contains_ip6_percent                       contains_ip6_percent                   max_percent         pii               max_percent=0.0
invalid_latitude                           invalid_latitude_count                 max_count           geographic        max_count=0
invalid_longitude                          invalid_longitude_count                max_count           geographic        max_count=0
true_percent                               true_percent                           min_max_percent     boolean
false_percent                              false_percent                          min_max_percent     boolean
date_values_in_future_percent              future_date_percent                    max_percent         datetime          max_percent=0.0
date_in_range_percent                      date_in_range_percent                  min_percent         datetime          min_percent=95.0
text_found_in_set_percent                  text_in_set_percent                    min_percent         accepted_values   min_percent=95.0
number_found_in_set_percent                number_in_set_percent                  min_percent         accepted_values   min_percent=95.0
expected_text_values_in_use_count          expected_text_in_use_count             min_count           accepted_values   min_count=1
expected_numbers_in_use_count              expected_number_in_use_count           min_count           accepted_values   min_count=1
expected_texts_in_top_values_count         expected_texts_top_n_count             min_count           accepted_values   min_count=1
text_valid_country_code_percent            valid_country_code_percent             min_percent         accepted_values   min_percent=95.0
text_valid_currency_code_percent           valid_currency_code_percent            min_percent         accepted_values   min_percent=95.0
text_not_matching_date_pattern_found       text_not_matching_date_count           max_count           datatype          max_count=0
text_not_matching_date_pattern_percent     text_not_matching_date_percent         max_percent         datatype          max_percent=0.0
text_match_date_format_percent             text_match_date_percent                min_percent         datatype          min_percent=95.0
text_not_matching_name_pattern_percent     text_not_matching_name_percent         max_percent         datatype          max_percent=5.0
text_parsable_to_boolean_percent           text_parsable_boolean_percent          min_percent         datatype          min_percent=95.0
text_parsable_to_integer_percent           text_parsable_integer_percent          min_percent         datatype          min_percent=95.0
text_parsable_to_float_percent             text_parsable_float_percent            min_percent         datatype          min_percent=95.0
text_parsable_to_date_percent              text_parsable_date_percent             min_percent         datatype          min_percent=95.0
detected_datatype_in_text                  detected_datatype                      equal_to            datatype          expected_value=5
detected_datatype_in_text_changed          detected_datatype_changed              not_equal_to        datatype          forbidden_value=1
foreign_key_not_found                      foreign_key_not_found_count            max_count           referential       max_count=0
foreign_key_found_percent                  foreign_key_found_percent              min_percent         referential       min_percent=95.0
total_row_count_match_percent              row_count_match_percent                min_percent         comparison        min_percent=95.0
total_sum_match_percent                    sum_match_percent                      min_percent         comparison        min_percent=95.0
total_min_match_percent                    min_match_percent                      min_percent         comparison        min_percent=100.0
total_max_match_percent                    max_match_percent                      min_percent         comparison        min_percent=100.0
total_average_match_percent                average_match_percent                  min_percent         comparison        min_percent=95.0
total_not_null_count_match_percent         not_null_count_match_percent           min_percent         comparison        min_percent=95.0
column_exists                              column_exists                          is_true             schema
data_freshness                             data_freshness                         max_value           timeliness        max_value=86400
data_ingestion_delay                       data_ingestion_delay                   max_value           timeliness        max_value=3600
column_type_changed                        column_type_changed                    not_equal_to        schema            forbidden_value=1
sql_condition_failed_on_column             sql_condition_failed_on_column_count   max_count           custom_sql        max_count=0
sql_condition_passed_percent_on_column     sql_condition_passed_on_column_percent min_percent         custom_sql        min_percent=95.0
sql_aggregate_expression_on_column         sql_aggregate_on_column_value          min_max_value       custom_sql
sql_invalid_value_count_on_column          sql_invalid_value_on_column_count      max_count           custom_sql        max_count=0
import_custom_result_on_column             import_custom_result_on_column         min_max_value       custom_sql
row_count_change                           row_count_change                       max_change_percent  change_detection  max_change_percent=10.0
nulls_percent_change                       nulls_percent_change                   max_value           change_detection  max_value=5.0
distinct_count_change                      distinct_count_change                  max_change_percent  change_detection  max_change_percent=10.0
distinct_percent_change                    distinct_percent_change                max_value           change_detection  max_value=5.0
mean_change                                mean_change                            max_change_percent  change_detection  max_change_percent=10.0
median_change                              median_change                          max_change_percent  change_detection  max_change_percent=10.0
sum_change                                 sum_change                             max_change_percent  change_detection  max_change_percent=10.0
row_count_match                            row_count                              min_percent         comparison        min_percent=100.0
column_count_match                         column_count                           min_percent         comparison        min_percent=100.0
sum_match                                  sum_value                              min_percent         comparison        min_percent=100.0
min_match                                  min_value                              min_percent         comparison        min_percent=100.0
max_match                                  max_value                              min_percent         comparison        min_percent=100.0
mean_match                                 mean_value                             min_percent         comparison        min_percent=100.0
not_null_count_match                       not_nulls_count                        min_percent         comparison        min_percent=100.0
null_count_match                           nulls_count                            min_percent         comparison        min_percent=100.0
distinct_count_match                       distinct_count                         min_percent         comparison        min_percent=100.0
"""

# Checks against the reading of 1, 7 or 30 days ago: the longer the gap, the
# more change is tolerated.
_CHANGE_TOLERANCE = {"1_day": 10.0, "7_days": 20.0, "30_days": 50.0}
_CHANGE_METRICS = {
    "row_count": "volume",
    "nulls_percent": "change",
    "distinct_count": "change",
    "distinct_percent": "change",
    "mean": "change",
    "median": "change",
    "sum": "change",
}

# Checks that compare a reading with the spread of its own history.
_ANOMALY_SENSORS = {
    "row_count": "row_count",
    "data_freshness": "data_freshness",
    "nulls_percent": "nulls_percent",
    "distinct_count": "distinct_count",
    "distinct_percent": "distinct_percent",
    "sum": "sum_value",
    "mean": "mean_value",
    "median": "median_value",
    "min": "min_value",
    "max": "max_value",
}


def _catalogue() -> dict[str, CheckType]:
    checks = {}
    for line in _CATALOGUE.strip().splitlines():
        name, sensor, rule, category, *thresholds = line.split()
        pairs = (item.split("=") for item in thresholds)
        checks[name] = CheckType(name, sensor, rule, category, {k: float(v) for k, v in pairs})
    for metric, category in _CHANGE_METRICS.items():
        for gap, tolerance in _CHANGE_TOLERANCE.items():
            name = f"{metric}_change_{gap}"
            checks[name] = CheckType(
                name, name, "max_change_percent", category, {"max_change_percent": tolerance}
            )
    for metric, sensor in _ANOMALY_SENSORS.items():
        name = f"{metric}_anomaly"
        checks[name] = CheckType(name, sensor, "anomaly_percentile", "anomaly")
    return checks


CHECKS: dict[str, CheckType] = _catalogue()


def dimension_of(check_type: str) -> str | None:
    """Quality dimension of a check type; None when it is not scored."""
    if check_type in CHECKS:
        return CHECKS[check_type].dimension
    from plumbline.operators.expectations import EXPECTATIONS

    expectation = EXPECTATIONS.get(check_type)
    return fixed.CATEGORY_DIMENSION.get(expectation.category) if expectation else None


def checks_of_dimension(dimension: str) -> list[str]:
    """Check types scored in a dimension."""
    return [name for name, check in CHECKS.items() if check.dimension == dimension]
