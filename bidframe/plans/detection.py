"""The detector's steps over the cells of many sheets, each run once and written."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from bidframe.config import DetectionWindow, HeaderThresholds
from bidframe.operators import schema_match as sm
from bidframe.sources.staging import staged


class Detection:
    """What the first rows of every sheet tell: header row, headers, column profiles, concepts.

    All of it is as large as the sampled rows at most, whatever the sheets hold; each table is
    written when first asked for, so that no later step runs the detector again.
    """

    def __init__(self, cells: DataFrame, window: DetectionWindow = DetectionWindow(),
                 th: HeaderThresholds = HeaderThresholds(), extra=None):
        self.cells, self.window, self.th, self.extra = cells, window, th, extra

    @cached_property
    def sample(self) -> DataFrame:
        return staged(sm.sample_cells(self.cells, self.window.sample_rows))

    @cached_property
    def rows(self) -> DataFrame:
        return staged(sm.find_header_row(self.sample, self.th, self.window.header_rows, self.window.sample_rows, staged))

    @cached_property
    def headers(self) -> DataFrame:
        return staged(sm.sheet_headers(self.sample, self.rows, self.window.sample_rows))

    @cached_property
    def profile(self) -> DataFrame:
        return staged(sm.column_profile(self.sample, self.rows, self.window.sample_rows))

    @cached_property
    def columns(self) -> DataFrame:
        return staged(sm.detect_columns(self.headers, self.profile, self.th, self.extra))

    @cached_property
    def resolved(self) -> DataFrame:
        return staged(sm.resolve_columns(self.columns))

    @cached_property
    def chosen(self) -> DataFrame:
        return staged(sm.select_sheet(self.columns, self.rows, self.sample, self.window.sample_rows))
