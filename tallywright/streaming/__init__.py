from tallywright.streaming.counts import daily_volume, frequency, latest, save_updates, volume_of_days

__all__ = ["daily_volume", "frequency", "latest", "save_updates", "volume_of_days"]
