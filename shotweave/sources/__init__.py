"""Readers and writers: stock catalogue JSON, edit lists, timelines, footage folders, captions and credits."""
