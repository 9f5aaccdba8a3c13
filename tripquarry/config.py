"""Limits that clients of the service use; the admission queue takes them."""

from __future__ import annotations

from dataclasses import dataclass

from .operators.admission import AdmissionQueue


@dataclass(frozen=True)
class ClientConfig:
    """Language and currency are kept for the record: pages come as they were captured."""

    language: str = "en"
    currency: str = "USD"
    timeout_s: int = 5
    connect_timeout_s: int = 5
    queries_per_second: int = 2
    max_retries: int = 3

    def queue(self, **options) -> AdmissionQueue:
        return AdmissionQueue.with_qps_limit(self.queries_per_second, max_retries=self.max_retries, **options)
