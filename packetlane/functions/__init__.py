"""Part of packetlane."""
