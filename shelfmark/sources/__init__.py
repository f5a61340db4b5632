"""Readers and writers. Readers return lazily and list nothing on the driver."""
